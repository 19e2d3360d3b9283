"""HTML -> relational rows. The engine's only Python stage.

``parse_pages`` runs the stdlib ``html.parser`` inside ``mapInArrow`` and emits
one row per page:

    page_id, url, text,
    elements: array<struct<node_id, parent_id, sib_idx, next_sib, last_desc, tag,
                           attrs: map<string,string>, text_start, text_end, raw_text>>
    nodes:    array<struct<pos, node_id, start, end, s_start, s_end>>,
    error:    null, or why the page could not be parsed

A page that the tokenizer refuses (malformed marked sections, for example) gives an empty
text and tree and its error; the other pages of the job go on (see ``parse_problems``).

``node_id`` is the element's index in the array (document order), so every
tree query (descendants, next sibling) is an array lookup inside the page's
own row: no self-join, no shuffle. An element's text is the slice
``text[text_start:text_end]`` of the page text; text nodes are slices as well.

Tree rules (those of the lenient "html.parser" tree builder): void tags never
have children, ``</x>`` closes the nearest open ``x`` and everything opened
after it and is ignored when no ``x`` is open, ``<p>`` does not close an open
``<p>``, entities are decoded, whitespace-only strings become one space (or
one newline when they hold one) outside pre/textarea, and strings inside
script/style/template/rt/rp and comments are not page text.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sitesift.dictionaries import HIDDEN_TEXT_TAGS

# --- FIXED VALUES: elements that never have content (HTML void elements plus legacy ones) ---
VOID_TAGS = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem",
    "meta", "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame",
    "image", "isindex", "nextid", "spacer",
])
PRESERVE_WS_TAGS = frozenset(["pre", "textarea"])
_HIDDEN = frozenset(HIDDEN_TEXT_TAGS)
_ASCII_WS = " \n\t\x0c\r"

ELEMENT_TYPE = T.StructType([
    T.StructField("node_id", T.IntegerType()),
    T.StructField("parent_id", T.IntegerType()),
    T.StructField("sib_idx", T.IntegerType()),
    T.StructField("next_sib", T.IntegerType()),
    T.StructField("last_desc", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text_start", T.IntegerType()),
    T.StructField("text_end", T.IntegerType()),
    T.StructField("raw_text", T.StringType()),
])
NODE_TYPE = T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField("node_id", T.IntegerType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("s_start", T.IntegerType()),
    T.StructField("s_end", T.IntegerType()),
])
PARSED_FIELDS = [
    T.StructField("text", T.StringType()),
    T.StructField("elements", T.ArrayType(ELEMENT_TYPE)),
    T.StructField("nodes", T.ArrayType(NODE_TYPE)),
    T.StructField("error", T.StringType()),
]
# a text, maybe empty, and the plainly written tag behind it: name and attributes, or closed name
_PLAIN = re.compile(r'([^<]*+)<(?:([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][-a-zA-Z0-9_:]*="[^"<>]*")*+)'
                    r'|/([a-zA-Z][a-zA-Z0-9]*))>')
_PLAIN_ATTR = re.compile(r'([a-zA-Z][-a-zA-Z0-9_:]*)="([^"]*)"')
# places in an element's row, which has the fields of ELEMENT_TYPE
_NEXT_SIB, _LAST_DESC, _SIB_IDX, _TAG, _TEXT_END, _RAW = map(
    ELEMENT_TYPE.names.index, ("next_sib", "last_desc", "sib_idx", "tag", "text_end", "raw_text"))
PART_PAGES, PART_CHARS = 64, 1 << 20     # pages held as Python objects at once, unless one is longer


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.pos = 0
        self.els: list[list] = []          # rows of ELEMENT_TYPE
        self.stack: list[int] = []
        self.open: dict[str, int] = {}       # open elements by tag
        self.unclosed: dict[str, int] = {}   # characters left where an opening had no closing sign
        self.last_child: dict[int, int] = {}
        self.pending: list[str] = []
        self.nodes: list[tuple] = []       # rows of NODE_TYPE
        self.hidden = 0
        self.preserve = 0

    def updatepos(self, i, j):      # nobody asks for line numbers
        return j

    # -- strings -------------------------------------------------------------
    def handle_data(self, data):
        self.pending.append(data)

    def _flush(self):
        if not self.pending:
            return
        s = "".join(self.pending)
        self.pending = []
        parent = self.stack[-1] if self.stack else -1
        if self.hidden:
            if parent >= 0 and self.els[parent][_TAG] == "script":
                e = self.els[parent]
                e[_RAW] = s if e[_RAW] is None else e[_RAW] + s
            return
        if not self.preserve and s.strip(_ASCII_WS) == "":
            s = "\n" if "\n" in s else " "
        start = self.pos
        self.parts.append(s)
        self.pos += len(s)
        lead = len(s) - len(s.lstrip())
        trail = len(s.rstrip())
        self.nodes.append((len(self.nodes), parent, start, self.pos,
                           start + (lead if lead < trail else trail), start + trail))

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def unknown_decl(self, data):
        self._flush()
        if data.startswith("CDATA["):
            self.pending.append(data[6:])
            self._flush()

    # An opening without its closing sign is text. The tokenizer looks for the sign anew at
    # each such opening; once it was missing from some place on, it is from later ones too.
    def parse_html_declaration(self, i):
        kind = self.rawdata[i:i + 9] if self.rawdata.startswith("<![", i) else self.rawdata[i:i + 4]
        left = len(self.rawdata) - i
        if left <= self.unclosed.get(kind, -1):
            return -1
        k = super().parse_html_declaration(i)
        if k < 0:
            self.unclosed[kind] = left
        return k

    def read(self, html):
        """The whole page. No tag ends behind its last ">": what stands there is text."""
        end = html.rfind(">") + 1
        self.feed(html[:end])
        self.close()
        if end < len(html):
            self.handle_data(html[end:] if self.cdata_elem else unescape(html[end:]))

    # -- tags ----------------------------------------------------------------
    # Plainly written tags, with the texts between them, are read by one pattern, all else by the tokenizer.
    def _plain(self, i):
        """Read on from the tag at ``i`` while tags are plainly written; the place reached."""
        raw, match = self.rawdata, _PLAIN.match
        while m := match(raw, i):
            text, tag, rest, closed = m.groups()
            if text:
                self.pending.append(unescape(text))
            i = m.end()
            if closed:
                self.handle_endtag(closed.lower())
                continue
            tag = tag.lower()
            self._start(tag, [(k.lower(), unescape(v)) for k, v in _PLAIN_ATTR.findall(rest)] if rest else (),
                        tag in VOID_TAGS)
            if tag in self.CDATA_CONTENT_ELEMENTS:
                self.set_cdata_mode(tag)
                break
        return i

    def parse_starttag(self, i):
        k = self._plain(i)
        return k if k > i else super().parse_starttag(i)

    def parse_endtag(self, i):
        k = self._plain(i) if self.cdata_elem is None else i
        return k if k > i else super().parse_endtag(i)

    def handle_starttag(self, tag, attrs):
        self._start(tag, attrs, tag in VOID_TAGS)

    def handle_startendtag(self, tag, attrs):
        self._start(tag, attrs, True)

    def _start(self, tag, attrs, void):
        if self.pending:
            self._flush()
        nid = len(self.els)
        parent = self.stack[-1] if self.stack else -1
        prev = self.last_child.get(parent)
        if prev is not None:
            e = self.els[prev]
            e[_NEXT_SIB] = nid
            sib = e[_SIB_IDX] + 1
        else:
            sib = 0
        self.last_child[parent] = nid
        amap = list({k: "" if v is None else v for k, v in attrs}.items()) if attrs else []
        self.els.append([nid, parent, sib, -1, nid, tag, amap, self.pos, self.pos, None])
        if not void:
            self.stack.append(nid)
            self.open[tag] = self.open.get(tag, 0) + 1
            if tag in _HIDDEN:
                self.hidden += 1
            if tag in PRESERVE_WS_TAGS:
                self.preserve += 1

    def _close(self, nid):
        e = self.els[nid]
        tag = e[_TAG]
        e[_TEXT_END] = self.pos
        e[_LAST_DESC] = len(self.els) - 1
        self.open[tag] -= 1
        if tag in _HIDDEN:
            self.hidden -= 1
        if tag in PRESERVE_WS_TAGS:
            self.preserve -= 1

    def handle_endtag(self, tag):
        if not self.open.get(tag):      # nothing to close: the stack need not be looked through
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.els[self.stack[i]][_TAG] == tag:
                self._flush()
                for nid in reversed(self.stack[i:]):
                    self._close(nid)
                del self.stack[i:]
                return

    def finish(self):
        self._flush()
        for nid in reversed(self.stack):
            self._close(nid)
        self.stack = []
        return "".join(self.parts), self.els, self.nodes


def _parse_rows(html: str | None):
    """(text, rows of ELEMENT_TYPE, rows of NODE_TYPE) of one page."""
    b = _TreeBuilder()
    if html:
        b.read(html)
    return b.finish()


def _rows_or_error(html: str | None):
    """``_parse_rows`` and None, or an empty page and the reason why it can't be parsed."""
    try:
        return *_parse_rows(html), None
    except Exception as e:  # noqa: BLE001 - whatever one page holds, the others go on
        return "", [], [], f"{type(e).__name__}: {str(e)[:200]}"


def _named(text, elements, nodes):
    return (text, [dict(zip(ELEMENT_TYPE.names, e)) for e in elements], [dict(zip(NODE_TYPE.names, n)) for n in nodes])


def parse_html(html: str | None):
    """Parse one page; returns (text, elements, nodes). Public for tests."""
    return _named(*_parse_rows(html))


def parse_or_error(html: str | None):
    """``parse_html`` and None, or an empty page and the reason why it can't be parsed."""
    *page, error = _rows_or_error(html)
    return *_named(*page), error


def _pieces(batch, column):
    """Slices of a batch of few pages or few characters."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and (i - lo == PART_PAGES or held + n > PART_CHARS):
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield batch.slice(lo)


def _structs(rows_of_pages: list[list], kind):
    """list<struct> column of a batch: one flat array per field, then offsets."""
    import itertools

    import pyarrow as pa

    flat = list(itertools.chain.from_iterable(rows_of_pages))
    struct = kind.value_type
    values = zip(*flat) if flat else [()] * struct.num_fields
    columns = [pa.array(v, f.type) for f, v in zip(struct, values)]
    offsets = pa.array([0, *itertools.accumulate(map(len, rows_of_pages))], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(struct)), type=kind)


def _parse_batches(batches, keep: list[str], id_col: str, html_col: str):
    import pyarrow as pa

    for whole in batches:
        schema = _arrow_schema(whole.schema, keep, id_col)
        at = whole.schema.get_field_index(html_col)
        for batch in _pieces(whole, whole.column(at)):
            texts, elems, nodes, errors = map(list, zip(*map(_rows_or_error, batch.column(at).to_pylist())))
            same = [batch.column(batch.schema.get_field_index(c)) for c in (id_col, *keep)]
            yield pa.RecordBatch.from_arrays(
                [*same, pa.array(texts, pa.string()), _structs(elems, schema.field("elements").type),
                 _structs(nodes, schema.field("nodes").type), pa.array(errors, pa.string())], schema=schema)


def _arrow_schema(in_schema, keep, id_col):
    import pyarrow as pa

    el = pa.struct([("node_id", pa.int32()), ("parent_id", pa.int32()), ("sib_idx", pa.int32()),
                    ("next_sib", pa.int32()), ("last_desc", pa.int32()), ("tag", pa.string()),
                    ("attrs", pa.map_(pa.string(), pa.string())), ("text_start", pa.int32()),
                    ("text_end", pa.int32()), ("raw_text", pa.string())])
    nd = pa.struct([("pos", pa.int32()), ("node_id", pa.int32()), ("start", pa.int32()),
                    ("end", pa.int32()), ("s_start", pa.int32()), ("s_end", pa.int32())])
    fields = [in_schema.field(id_col)] + [in_schema.field(k) for k in keep]
    fields += [pa.field("text", pa.string()), pa.field("elements", pa.list_(el)),
               pa.field("nodes", pa.list_(nd)), pa.field("error", pa.string())]
    return pa.schema(fields)


def parse_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                keep: tuple[str, ...] = ("url",), min_partitions: int | None = None) -> DataFrame:
    """Parse every page once into (id, keep..., text, elements, nodes, error).

    Pages are independent, so this is a narrow stage over the input's own partitions;
    ``min_partitions`` deals them out anew first (for a few large splits).
    """
    keep = [k for k in keep if k != id_col]
    src = pages.select(id_col, *keep, html_col)
    if min_partitions:
        src = src.repartition(min_partitions)
    out_schema = T.StructType([src.schema[id_col]] + [src.schema[k] for k in keep] + PARSED_FIELDS)

    def fn(batches):
        return _parse_batches(batches, keep, id_col, html_col)

    _ship_by_value()
    return src.mapInArrow(fn, out_schema)


def parse_problems(parsed: DataFrame) -> DataFrame:
    """One row (page_id, url, level, message) per page that could not be parsed."""
    from pyspark.sql import functions as F

    return parsed.where(F.col("error").isNotNull()).select(
        "page_id", "url", F.lit("error").alias("level"), F.concat(F.lit("page could not be parsed: "), "error").alias("message"))


def _ship_by_value():
    """Pickle this module's code into the task, so executors need no install of the package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
