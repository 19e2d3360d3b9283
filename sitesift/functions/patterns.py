"""Regular expressions, written for Java regex.

Every pattern starts with (?U) so that \\b, \\w, \\d and \\s are Unicode-aware,
which is how Python's ``re`` treats str patterns; without it Java's \\s misses
NBSP and \\b differs on accented letters.
"""

from os.path import commonprefix

U = "(?U)"

# --- FIXED VALUES: extraction patterns (the e-mail TLD class keeps a literal '|') ---
EMAIL = U + r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
# A leftmost phone match starts at the end of the match before, at a plus, or where its run of
# digits, spaces, dots and hyphens starts (one starting inside the run could start earlier), so
# only these positions are tried: long runs cost linear time.
PHONE = U + r"(?:\G|(?<![\d\s.-])|(?=\+))" + r"\+?[\d\s.-]+\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"
# further words of a name are matched possessively: every word ends at a word boundary, so
# giving one back never helps, and Java repeats a possessive group in a loop, not by recursion
NAME = (U + r"\b(?!(?:Email|Contact|sent by)\b)(?:Dr\.|Mr\.|Ms\.|Mrs\.|Prof\.)?\s*"
        r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+\b)++)")
# "wrapper" profile: single spaces between name words, no honorific or skip words
WRAPPER_NAME = U + r"\b[A-Z][a-z]+(?: [A-Z][a-z]+\b)++"
WRAPPER_PHONE = U + r"\b(?:\+\d{1,2}\s?)?(?:\(\d{3}\)|\d{3})[-.\s]?\d{3}[-.\s]?\d{4}\b"

# --- FIXED VALUES: validation patterns (whole value) ---
V_EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
V_LINKEDIN = U + r"^https?://(?:www\.)?linkedin\.com/in/[\w\-]+/?$"
V_PHONE = U + r"^\+?[\d\s.-]+\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}$"

MIN_TEXT_LEN = 3


def title_alternation(keywords: list[str]) -> str:
    """Case-insensitive whole-word alternation in dictionary order.

    Keywords are used as written (not escaped), so a keyword is itself a
    pattern, e.g. ``Dr.`` matches ``Dr`` followed by any character. Keywords that begin
    alike are tried through their common beginning, so a place of a text costs the
    different beginnings, not the keywords.
    """
    plain = all(0 < len(k) <= 200 and not set(k) & _MARKS and _closed(k) for k in keywords)
    return "(?iU)\\b(" + (_by_beginning(list(keywords)) if plain else "|".join(keywords)) + ")\\b"


_MARKS = set("|\\[]{}*+?^$#")      # with these a keyword's signs don't stand for themselves one by one


def _plain(c: str) -> bool:
    return c == " " or (c.isascii() and c.isalnum())


def _closed(keyword: str) -> bool:
    depth = 0
    for c in keyword:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    return depth == 0


def _by_beginning(rests: list[str]) -> str:
    """The alternation of ``rests`` in their order. Where two begin with different letters or
    digits at most one can match, so those of a letter may be gathered at its first place;
    the order of those that match at one place stays."""
    if len(rests) == 1:
        return rests[0]
    out, groups = [], {}

    def put():
        for c, g in groups.values():
            if len(g) > 1:
                n = len(common := commonprefix([r.lower() for r in g]))
                while n and not all(map(_plain, common[:n])):
                    n -= 1
                c, g = c + g[0][:n], [r[n:] for r in g]
            out.append(c + (g[0] if len(g) == 1 else f"(?:{_by_beginning(g)})"))
        groups.clear()

    for r in rests:
        c = r[:1]
        if _plain(c):
            groups.setdefault(c.lower(), (c, []))[1].append(r[1:])
        else:               # an end, or a sign of a pattern: what comes before it is tried before it
            put()
            out.append(r)
    put()
    return "|".join(out)
