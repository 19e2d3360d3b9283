import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sitesift.session import build_session
    s = build_session("local[4]", **{"spark.sql.shuffle.partitions": "4", "sitesift.read.partitions": "4"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def pages_of(spark):
    def make(*htmls, base="http://a.example.com/"):
        rows = [(i + 1, f"{base}{i + 1}", h) for i, h in enumerate(htmls)]
        return spark.createDataFrame(rows, "page_id long, url string, html string")
    return make


# Golden pages (FIXTURES.md section 2)
FA = ('<html><head><meta name="Description" content="Ask Omar Haddad, Sales Director"></head><body>'
      '<p class="contact">Ines Duarte - CEO</p><p>Email: ines@site-a.example.com</p><p>Phone: (212) 555-0101</p>'
      '<p>Fax 212-555-0102</p><div id="contact-us"><a href="mailto:omar@site-a.example.com?subject=hi">Write Omar</a>'
      '</div></body></html>')
FB = ('<html><head><style>.x{}</style><script type="application/ld+json">[{"@type":"Person","name":"Ravi Menon",'
      '"jobTitle":"VP","telephone":"555"},{"@type":"Person","name":"Not Used"}]</script><script type="application/ld+json">'
      '{bad</script></head><body><div class="about-Team"><p>Lena Vogel Project Manager</p><p>lena@site-b.example.com</p>'
      '<p>Call (212) 555-0103</p></div><h2>Our People</h2><section>Dr. Yuki Sato Chief Officer</section>'
      '<div class="vcard"><span class="fn">Ana Ruiz</span><span class="org">Acme Org</span><span class="email">ana@x'
      '</span><span class="tel">n/a</span></div><p>Tel (212) 555-0199</p><a href="mailto:jo@site-b.example.com">'
      'Contact Jo Park</a></body></html>')
FB_TITLES = ["Director", "Project", "Manager", "Chief", "Officer", "Project Manager", "VP", "Marketing", "Dr.", "IT"]
