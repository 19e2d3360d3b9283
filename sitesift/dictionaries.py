"""Dictionaries used by the extraction and crawl operators.

Every operator takes its dictionary as an argument (a Python list or a
DataFrame); the lists below are defaults. Lists whose contents must equal the
behaviour being reproduced are marked FIXED VALUES and kept in their natural
order, because order decides which keyword wins a match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# --- FIXED VALUES: page-context keywords by weight (order inside a weight kept) ---
CONTEXT_KEYWORDS = {
    "high": ["about", "team", "contact", "leadership", "management", "staff",
             "employees", "board", "executives"],
    "medium": ["directory", "people", "department", "faculty", "personnel", "crew",
               "members", "positions", "roles"],
    "low": ["company", "organization", "group", "division", "unit", "leaders", "managers"],
}

# --- FIXED VALUES: confidence of a mention found in a context block ---
BASE_CONFIDENCE = 0.5
WEIGHT_FACTOR = {"high": 1.2, "medium": 1.1, "low": 1.0}

# --- FIXED VALUES: URL / link-text keywords that raise a link's crawl relevance ---
URL_KEYWORDS = [
    "our-story", "join-us", "company-info", "about-company", "employees",
    "get-in-touch", "people", "divisions", "team", "board", "contact-us",
    "directors", "leadership", "about-team", "history", "social",
    "departments", "news", "reach-us", "offices", "executives", "work-with-us",
    "awards", "directory", "company", "what-we-do", "media", "careers",
    "meet-the-team", "press", "corporate", "insights", "staff", "publications",
    "events", "blog", "support", "founder", "who-we-are", "management",
    "about-us", "mission", "locations", "values", "help", "our-team", "contact",
]

# --- FIXED VALUES: URL endings that are not HTML pages (case-sensitive) ---
NON_HTML_SUFFIXES = [".json", ".css", ".png", ".jpg", ".svg", ".ico", ".js", ".gif", ".pdf", ".xml"]

# --- FIXED VALUES: relevance rank of a mention type in the "wrapper" profile ---
TYPE_RANK = {"email": 5, "name": 4, "phone": 3, "title": 2}
OTHER_RANK = 1

# --- FIXED VALUES: title keywords of the "wrapper" profile (substring test) ---
WRAPPER_TITLES = [
    "CEO", "CTO", "CFO", "COO", "President", "Vice President", "Director",
    "Manager", "Engineer", "Developer", "Designer", "Analyst", "Specialist",
    "Coordinator", "Administrator", "Supervisor", "Lead", "Head", "Chief",
    "Technician", "Scientist", "Pilot", "Inspector", "Consultant", "Architect",
    "Operator", "Instructor", "Planner", "Strategist", "Estimator", "Fabricator",
    "Assembler", "Machinist", "Welder", "Mechanic", "Tester", "Trainer",
    "Project Manager", "Program Manager", "Systems Engineer", "Avionics Engineer",
    "Test Engineer", "Flight Engineer", "Manufacturing Engineer", "Quality Engineer",
    "Structural Engineer", "Aerospace Engineer", "Electrical Engineer", "Software Engineer",
    "Mechanical Engineer", "Materials Engineer", "Safety Engineer", "Reliability Engineer",
    "Design Engineer", "Research Scientist", "Principal Investigator", "Field Service Engineer",
    "Compliance Manager", "Logistics Manager", "Supply Chain Manager", "Production Manager",
    "Operations Manager", "Business Development Manager", "Customer Service Manager",
    "Integration Engineer", "Mission Manager", "Payload Specialist", "Propulsion Engineer",
    "Satellite Engineer", "Thermal Engineer", "Dynamics Engineer", "RF Engineer",
    "Guidance, Navigation, and Control (GNC) Engineer", "Ordnance Engineer", "Launch Director",
    "Ground Systems Engineer", "Mission Operations Engineer", "Systems Architect",
    "Configuration Manager", "Risk Manager", "Test Technician", "Calibration Technician",
    "Electronics Technician", "Maintenance Technician", "Program Analyst", "Budget Analyst",
    "Contract Administrator", "Procurement Specialist", "Inventory Manager", "Supply Chain Analyst",
    "IT Manager", "Cybersecurity Specialist", "Data Scientist", "AI Specialist", "Robotics Engineer",
    "Control Systems Engineer", "Optical Engineer", "Spacecraft Operations Specialist",
    "Business Analyst", "Marketing Manager", "Sales Manager", "Communications Manager",
    "Human Resources Manager", "Talent Acquisition Specialist", "Training Coordinator",
    "Safety Manager", "Environmental Engineer", "Sustainability Manager", "Innovation Manager",
    "Customer Support Engineer", "Technical Support Specialist", "Field Operations Manager",
    "Quality Assurance Manager", "Regulatory Affairs Manager", "Patent Agent", "Legal Counsel",
]

# Default title dictionary of the "contextual" profile. This list is our own,
# not the long list of the original tool: pass your own dictionary (a list or a
# DataFrame with columns keyword, ord) to reproduce another vocabulary. Order
# matters: at one text position the earlier keyword wins.
DEFAULT_TITLES = [
    "CEO", "CTO", "CFO", "COO", "President", "Director", "Chief", "Founder",
    "Manager", "Engineer", "Developer", "Designer", "Analyst", "Specialist",
    "Coordinator", "Administrator", "Supervisor", "Consultant", "Architect",
    "Scientist", "Technician", "Officer", "Partner", "Head", "Lead", "VP",
    "Project Manager", "Product Manager", "Sales Manager", "Marketing Manager",
    "Account Manager", "Office Manager", "Editor", "Recruiter", "Accountant",
    "Attorney", "Professor", "Researcher", "Assistant", "Associate", "Intern",
    "Secretary", "Treasurer", "Chairman", "Owner",
]

# Tags whose direct text never counts as page text (raw-text containers).
HIDDEN_TEXT_TAGS = ["script", "style", "template", "rt", "rp"]

MAX_DICTIONARY = 2_000      # keywords of a dictionary that is compiled into constant expressions


def keyword_list(d) -> list[str]:
    """Accept a list or a DataFrame(keyword, ord) and return keywords in order, for
    operators that compile them into constant expressions. A longer dictionary is refused
    here, never truncated: the operators take it as a table instead (``large_dictionary``)."""
    if d is None:
        return list(DEFAULT_TITLES)
    if isinstance(d, DataFrame):
        found = [r.keyword for r in d.select("keyword", "ord").orderBy("ord").limit(MAX_DICTIONARY + 1).collect()]
    else:
        found = list(d)
    if len(found) > MAX_DICTIONARY:
        raise ValueError(f"more than {MAX_DICTIONARY} keywords in a constant expression; use the operators of "
                         "sitesift.operators.vocabulary")
    return found


def large_dictionary(spark, d) -> DataFrame | None:
    """``d`` as a table (keyword, ord) if it is too long for constant expressions, else None."""
    if isinstance(d, DataFrame):
        return d if len(d.limit(MAX_DICTIONARY + 1).collect()) > MAX_DICTIONARY else None
    if d is None or len(d) <= MAX_DICTIONARY:
        return None
    return spark.createDataFrame([(k, i) for i, k in enumerate(d)], "keyword string, ord long")


def all_context_keywords(ctx: dict | None = None) -> list[str]:
    ctx = ctx or CONTEXT_KEYWORDS
    return [k for kws in ctx.values() for k in kws]
