"""URL column functions: parse, normalize, resolve, filter.

All built-in expressions. URL parsing uses the RFC 3986 appendix-B split with
the scheme restricted to scheme characters, which reproduces Python's
``urlsplit`` on the inputs we see (it keeps userinfo, port, spaces and
non-ASCII paths; Spark's ``parse_url`` drops the port and fails on spaces).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitesift.dictionaries import NON_HTML_SUFFIXES

__all__ = [
    "url_scheme", "url_netloc", "url_path", "url_query", "url_fragment",
    "url_path_noparams", "normalize_url", "with_joined_url", "is_html_url",
]

URI_RE = r"^(([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"

# --- FIXED VALUES: schemes that resolve relative references / carry a netloc
# (Python's urllib.parse.uses_relative / uses_netloc) ---
USES_RELATIVE = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp",
                 "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss"]
USES_NETLOC = ["", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms",
               "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn",
               "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _g(c, i) -> Column:
    return F.regexp_extract(_c(c), URI_RE, i)


def url_scheme(c) -> Column:
    return F.lower(_g(c, 2))


def url_netloc(c) -> Column:
    return _g(c, 4)


def url_path(c) -> Column:
    return _g(c, 5)


def url_query(c) -> Column:
    return _g(c, 7)


def url_fragment(c) -> Column:
    return _g(c, 9)


def url_path_noparams(c) -> Column:
    """Path without ';params' of its last segment (what ``urlparse().path`` returns)."""
    return F.regexp_replace(url_path(c), r";[^/]*$", "")


def normalize_url(c) -> Column:
    """URL identity: lower-case, then 'http://' + netloc + path (scheme, query and
    fragment ignored); null when the URL has no netloc (not a complete URL)."""
    low = F.lower(_c(c))
    net = url_netloc(low)
    return F.when(net != "", F.concat(F.lit("http://"), net, url_path_noparams(low)))


def _in(c: Column, values: list[str]) -> Column:
    return c.isin(*values)


def _remove_dot_segments(segs: Column) -> Column:
    """Resolve '.' and '..' over an array of path segments (RFC 3986 5.2.4 as urljoin does)."""
    resolved = F.aggregate(
        segs, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
                              .otherwise(acc))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))))
    last = F.element_at(segs, -1)
    resolved = F.when(last.isin(".", ".."), F.concat(resolved, F.array(F.lit("")))).otherwise(resolved)
    joined = F.array_join(resolved, "/")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def _unparse(scheme, netloc, path, query, fragment) -> Column:
    """urlunparse: each part is referenced a bounded number of times (no nesting)."""
    has_net = (netloc != "") | (scheme.isin(*USES_NETLOC) & (scheme != ""))
    lead = F.when(has_net & (path != "") & ~path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
                    F.when(has_net, F.concat(F.lit("//"), netloc)).otherwise(F.lit("")),
                    lead, path,
                    F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
                    F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")))


def _unpadded(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^[\\x00-\\x20]+", ""), "[\\t\\r\\n]", "")


def with_joined_url(df, base: str, href: str, out: str = "abs_url"):
    """Add ``out`` = ``href`` resolved against ``base`` like ``urllib.parse.urljoin``.

    Each URL part is computed once into its own staged column (plain columns:
    struct fields would be inlined back into every use). Note for callers: a
    filter placed above this projection is pushed down by substituting the
    staged definitions level by level, which multiplies the expression; drop
    rows through an aggregate's output instead (see links.unique_links).
    """
    u = "_uj_"
    b, h = F.col(base), F.col(href)
    # leading controls and spaces, and tabs and line ends anywhere, are not part of a URL
    clean = {"cb": _unpadded(b), "ch": _unpadded(h)}
    df = df.withColumns({u + k: v for k, v in clean.items()})
    cb, ch = F.col(u + "cb"), F.col(u + "ch")
    parts = {
        "bs": url_scheme(cb), "bn": url_netloc(cb), "bp": url_path(cb), "bq": url_query(cb),
        "hs": url_scheme(ch), "hn": url_netloc(ch), "hp": url_path_noparams(ch),
        # ';params' of the last segment; an empty one is dropped, as when a URL is put together
        "hm": F.regexp_extract(url_path(ch), r";[^/;][^/]*$|;;[^/]*$", 0), "hq": url_query(ch), "hf": url_fragment(ch),
    }
    df = df.withColumns({u + k: v for k, v in parts.items()})
    c = {k: F.col(u + k) for k in parts}
    df = df.withColumn(u + "s", F.when(c["hs"] == "", c["bs"]).otherwise(c["hs"]))
    S = F.col(u + "s")
    # relative path: base directory + href path, empty middle segments dropped
    bparts = F.split(F.regexp_replace(c["bp"], r";[^/]*$", ""), "/")
    bdir = F.when(F.element_at(bparts, -1) != "", F.slice(bparts, 1, F.size(bparts) - 1)).otherwise(bparts)
    df = df.withColumn(u + "r", F.concat(bdir, F.split(c["hp"], "/")))
    R = F.col(u + "r")
    n = F.size(R)
    rel = F.when(n >= 2, F.concat(F.slice(R, 1, 1),
                                  F.filter(F.slice(R, 2, F.greatest(n - 2, F.lit(0))), lambda x: x != ""),
                                  F.slice(R, -1, 1))).otherwise(R)
    df = df.withColumn(u + "m", _remove_dot_segments(F.when(c["hp"].startswith("/"), F.split(c["hp"], "/"))
                                                     .otherwise(rel)))
    M = F.col(u + "m")
    net_abs = S.isin(*USES_NETLOC) & (c["hn"] != "")
    netloc = F.when(net_abs, c["hn"]).otherwise(c["bn"])
    res = (F.when(b.isNull() | (b == ""), h)
           .when(h.isNull() | (h == ""), b)
           .when((S != c["bs"]) | ~S.isin(*USES_RELATIVE), h)
           .when(net_abs, _unparse(S, c["hn"], F.concat(c["hp"], c["hm"]), c["hq"], c["hf"]))
           .when((c["hp"] == "") & (c["hm"] == ""), _unparse(S, netloc, c["bp"], F.when(c["hq"] != "", c["hq"]).otherwise(c["bq"]), c["hf"]))
           .otherwise(_unparse(S, netloc, F.concat(M, c["hm"]), c["hq"], c["hf"])))
    return df.withColumn(out, res).drop(*[u + k for k in (*parts, *clean)], u + "s", u + "r", u + "m")


NON_HTML_RE = "(" + "|".join(x.replace(".", "\\.") for x in NON_HTML_SUFFIXES) + ")$"


def is_html_url(c) -> Column:
    """False for URLs ending in a non-HTML suffix (case-sensitive, whole URL) or starting with 'mailto'."""
    c = _c(c)
    return ~c.rlike(NON_HTML_RE) & ~c.startswith("mailto")
