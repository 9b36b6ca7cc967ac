"""One document at a time: axes and parts of a parsed document, as plain Python over its node list.

Documents never meet, so every part of a paper is a map over documents: nothing
is joined, sorted or shuffled, and a task holds one document's nodes.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.headings import BOILERPLATE, CANONICAL, key_of
from ..functions.text import label_of
from ..sources.tei import TEXT, XML_ERRORS, flatten_xml

#: A batch of results is passed on after so many nodes.
HELD = 20_000


class Tree:
    """The nodes of a document by their place in it: ``end``, ``parent``, ``tag``, ``attrs`` and ``text``."""

    def __init__(self, nodes):
        self.end, self.parent, self.tag, self.attrs, self.text = [], [], [], [], []
        self.places: dict[str, list[int]] = {}
        for pre, end, parent, _, tag, attrs, text in nodes:
            self.end.append(end)
            self.parent.append(parent)
            self.tag.append(tag)
            self.attrs.append(attrs)
            self.text.append(text)
            self.places.setdefault(tag, []).append(pre)
        self.chunks = self.places.get(TEXT, [])
        self.known: dict[int, str] = {}

    def named(self, tag: str) -> list[int]:
        return self.places.get(tag, [])

    def attr(self, pre: int, name: str) -> str | None:
        return next((v for k, v in self.attrs[pre] or () if k == name), None)

    def within(self, places: list[int], pre: int) -> list[int]:
        """Those of the places that are below an element."""
        return places[bisect_right(places, pre) : bisect_right(places, self.end[pre])]

    def below(self, places: list[int], tops: list[int]) -> list[int]:
        """Those of the places that are below any of the elements."""
        out, last, k = [], -1, 0
        for pre in places:
            while k < len(tops) and tops[k] < pre:
                last = max(last, self.end[tops[k]])
                k += 1
            if pre <= last:
                out.append(pre)
        return out

    def inside(self, path: str) -> list[int]:
        """Elements below a chain of ancestors, outermost first: ``text/body//div`` is ``text>body>>div``.

        ``>`` is a child step and ``>>`` a descendant step; the first name may stand anywhere.
        """
        first, *steps = re.split("(>>|>)", path)
        current = self.named(first)
        for way, tag in zip(steps[::2], steps[1::2], strict=True):
            if way == ">":
                tops = set(current)
                current = [pre for pre in self.named(tag) if self.parent[pre] in tops]
            else:
                current = self.below(self.named(tag), current)
        return current

    def content(self, pre: int) -> str:
        """Text of an element: its chunks with a blank between any two, white space collapsed."""
        if pre not in self.known:
            at, to = bisect_right(self.chunks, pre), bisect_right(self.chunks, self.end[pre])
            self.known[pre] = " ".join(" ".join([self.text[i] or "" for i in self.chunks[at:to]]).split())
        return self.known[pre]

    def child(self, pre: int, tag: str) -> str | None:
        """Text of the first child of that tag; None if there is none."""
        return next((self.content(i) for i in self.within(self.named(tag), pre) if self.parent[i] == pre), None)


def _first(t: Tree, path: str, where=lambda pre: True):
    """(text,) of the first element on a path, None if blank; nothing if there is none."""
    return next(([(t.content(pre) or None,)] for pre in t.inside(path) if where(pre)), [])


def title(t: Tree):
    return _first(t, "teiHeader>>titleStmt>title")


def doi(t: Tree):
    return _first(t, "teiHeader>>sourceDesc>>biblStruct>>idno", lambda pre: t.attr(pre, "type") == "DOI")


def journal(t: Tree):
    return _first(t, "teiHeader>>sourceDesc>>biblStruct>monogr>title")


def metadata(t: Tree):
    """(title, doi, journal), one row a document."""
    return [tuple(found[0][0] if found else None for found in (title(t), doi(t), journal(t)))]


def authors(t: Tree):
    """(n, name, affiliation); see ``extract.authors``."""
    out = []
    addresses = t.named("address")
    for person in t.inside("teiHeader>>sourceDesc>>biblStruct>analytic>author"):
        affiliations: dict[str, str] = {}
        for place in t.within(t.named("affiliation"), person):
            parts: dict[str, str] = {}
            for pre in t.within(t.named("orgName"), place):
                parts.setdefault(t.content(pre).lower(), t.content(pre))
            # addresses around the affiliation count too
            open_ = [a for a in addresses if a <= t.end[place] and t.end[a] > place]
            for pre in t.below(list(range(place + 1, t.end[place] + 1)), open_) if open_ else ():
                if t.tag[pre] not in (TEXT, "label"):
                    parts.setdefault(t.content(pre).lower(), t.content(pre))
            whole = ", ".join(p for p in parts.values() if p) or t.content(place)
            if whole:
                affiliations.setdefault(whole.lower(), whole)
        name = t.child(person, "persName") or None
        if name is not None or affiliations:
            out.append((len(out) + 1, name, "; ".join(affiliations.values()) or None))
    return out


def heads(t: Tree):
    """(pre, head) of all headings of body divisions."""
    return [(pre, t.content(pre)) for pre in t.inside("text>body>>div>head") if t.content(pre)]


def sections(t: Tree):
    """(ord, head, key, text, canonical); see ``extract.body_sections``."""
    paragraphs = [pre for pre in sorted(t.named("p") + t.named("ab")) if t.content(pre)]
    slots: dict[tuple, list] = {}
    for div in t.inside("text>body>>div"):
        head = t.child(div, "head")
        if not head:
            continue
        key = key_of(head)
        if key in BOILERPLATE or key.startswith(("fig.", "table")):
            continue
        text = " ".join([t.content(pre) for pre in t.within(paragraphs, div)])
        if text:
            canonical = key in CANONICAL
            slots.setdefault((canonical, key if canonical else head), [div, head, key, []])[3].append(text)
    return [(div, head, key, "\n\n".join(texts), canonical) for (canonical, _), (div, head, key, texts) in slots.items()]


def keywords(t: Tree):
    """(keywords,); nothing if there are none."""
    terms: dict[str, str] = {}
    for pre in t.inside("teiHeader>>profileDesc>>textClass>>keywords>>term"):
        if t.content(pre):
            terms.setdefault(t.content(pre).lower(), t.content(pre))
    return [(list(terms.values()),)] if terms else []


def abstract_parts(t: Tree):
    """(header, keywords): the header's abstract and the keywords, one row a document."""
    header, words = _first(t, "teiHeader>>profileDesc>abstract"), keywords(t)
    return [(header[0][0] if header else None, words[0][0] if words else None)]


def abstract(t: Tree, found=None):
    """(abstract,); see ``extract.abstracts``.  ``found``: the document's sections, if they are known."""
    own = next((text for _, _, key, text, _ in (sections(t) if found is None else found) if key == "abstract"), None)
    ((header, words),) = abstract_parts(t)
    text = header if own is None else own
    if words:
        bare = (text or "").rstrip()
        text = (bare + " " if bare else "") + ", ".join(words) + " "
    return [(text,)] if text is not None else []


_WHOLE = re.compile("[0-9]+")


def _pages(t: Tree, places: list[int]) -> list[int | None]:
    """The page of each place: the nearest page break before it, which must have a number."""
    breaks, out = t.named("pb"), []
    for pre in places:
        k = bisect_left(breaks, pre)
        n = (t.attr(breaks[k - 1], "n") or "").strip(" ") if k else ""
        out.append(int(n) if _WHOLE.fullmatch(n) and int(n) < 1 << 31 else None)
    return out


def pages(t: Tree, path: str | None = None):
    """(pre, nth, page) of all elements, or of those on a path."""
    places = [pre for pre, tag in enumerate(t.tag) if tag != TEXT] if path is None else t.inside(path)
    return [(pre, nth, page) for nth, (pre, page) in enumerate(zip(places, _pages(t, places), strict=True))]


def zones(t: Tree):
    """(zone_id, page, ulx, uly, lrx, lry), as written, of facsimile zones right below a surface."""
    surfaces = set(t.named("surface"))
    return [
        (t.attr(z, "xml:id"), (t.attr(t.parent[z], "n") or "").strip(" "), *[t.attr(z, k) for k in ("ulx", "uly", "lrx", "lry")])
        for z in t.named("zone")
        if t.parent[z] in surfaces
    ]


_FACS = re.compile("#(.+)$")
_CAPTION = re.compile(r"table\s+([A-Za-z0-9]+)\s*[:.\-]\s*(.+)", re.ASCII | re.I | re.S)


def media(t: Tree):
    """(kind, stage, pre, label, caption, source, raw, page, zones); see ``extract.media``."""
    text, known_zones = t.named("text"), zones(t) if t.named("zone") else []
    out, seen = [], set()

    def put(kind, stage, pre, label, caption):
        key = label if label is not None else caption
        if key is None or (kind, key) in seen:
            return
        seen.add((kind, key))
        graphic = next(iter(t.within(t.named("graphic"), pre)), None)
        facs = _FACS.match(t.attr(pre, "facs") or "")
        at = [z[1:] for z in known_zones if facs and z[0] == facs[1]]
        out.append((kind, stage, pre, label, caption, "tei", None if graphic is None else t.attr(graphic, "coords"), _pages(t, [pre])[0], at))

    for pre in t.below(t.named("figure"), text):
        raw, head, desc = (t.child(pre, tag) or "" for tag in ("label", "head", "figDesc"))
        kind = "table" if (t.attr(pre, "type") or "").strip(" ").lower() == "table" else "figure"
        put(kind, 0, pre, label_of(kind, raw, head, desc or head), desc or head or None)
    for pre in t.below(t.named("table"), text):
        head = t.child(pre, "head") or ""
        put("table", 1, pre, label_of("table", None, head, head), head or None)

    labels = {label for kind, _, _, label, *_ in out if kind == "table"}

    def add(stage, pre, label, caption, source):
        if label not in labels:
            labels.add(label)
            out.append(("table", stage, pre, label, caption, source, None, None, []))

    paragraphs = t.below(t.named("p"), text)
    in_text = set(paragraphs)
    for pre in t.below(t.named("ref"), text):
        if t.attr(pre, "type") != "table" or not t.content(pre):
            continue
        # the innermost paragraph around it
        around, up = "", t.parent[pre]
        while up >= 0 and t.tag[up] != "p":
            up = t.parent[up]
        if up in in_text:
            around = t.content(up)
        named = r"\btable\s*" + re.escape(t.content(pre))
        after = re.search(named + r"\s*[:.\-]\s*(.+)", around, re.I)
        caption = (after[1].strip() if after else "") or re.sub(named + r"\b", "", around, flags=re.I).strip()
        add(2, pre, f"Table {t.content(pre)}", caption or None, "tei-ref")
    for pre in paragraphs:
        begins = _CAPTION.match(t.content(pre))
        if begins:
            add(3, pre, f"Table {begins[1]}", begins[2], "tei-text")
    return out


def references(t: Tree):
    """(index, text, id, title, doi, year, authors); see ``extract.references``."""
    out = []
    for entry in t.inside("text>back>>listBibl>biblStruct"):
        direct = lambda pre, above: t.tag[t.parent[pre]] == above and t.parent[t.parent[pre]] == entry  # noqa: B023, E731
        first = lambda tag, cond: next((t.content(pre) for pre in t.within(t.named(tag), entry) if cond(pre)), "") or None  # noqa: B023, E731
        main = first("title", lambda pre: direct(pre, "analytic") and t.attr(pre, "type") == "main")  # noqa: B023
        book = first("title", lambda pre: direct(pre, "monogr"))  # noqa: B023
        number = first("idno", lambda pre: t.attr(pre, "type") == "DOI")
        year = first("date", lambda pre: t.attr(pre, "type") == "published")
        people = [t.content(pre) for pre in t.within(t.named("author"), entry) if direct(pre, "analytic") and t.content(pre)]
        out.append((len(out) + 1, t.content(entry) or None, t.attr(entry, "xml:id"), main if main is not None else book, number, year, people or None))
    return out


def record(t: Tree):
    """All parts of a document as one row: title, journal, doi, authors, keywords, sections, other_sections, media, references."""
    found, words = sections(t), keywords(t)
    texts = [("abstract", a) for (a,) in abstract(t, found)] + [(key, text) for _, _, key, text, canonical in found if canonical and key != "abstract"]
    others = [(head, text) for _, head, _, text, canonical in found if not canonical]
    none = not texts and not others
    name, number, where = metadata(t)[0]
    return [
        (name, where, number, [a[1:] for a in authors(t)] or None, words[0][0] if words else None, None if none else texts, None if none else others, media(t) or None, references(t) or None)
    ]


def _nodes_of(batches):
    """(doc_id, nodes, None) of each document of a node table that comes in order."""
    doc, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and row[0] != doc:
                yield (doc,), held, None
                held = []
            doc = row[0]
            held.append(row[1:])
    if held:
        yield (doc,), held, None


def _parsed(batches):
    """((doc_id, ...), nodes, error) of each document; its text is the last column."""
    for batch in batches:
        for i in range(batch.num_rows):
            *given, text = (c[i].as_py() for c in batch.columns)
            try:
                if text is None:
                    raise ValueError("no document")
                yield given, flatten_xml(text), None
            except XML_ERRORS as why:
                yield given, [], str(why)


def each(source: DataFrame, rows, schema: str, carried: str = "", errors: bool = False) -> DataFrame:
    """(doc_id, carried..., schema...): the ``rows`` of each document of ``source``.

    ``source``: documents (doc_id, xml), which are parsed on the way, or a node
    table, whose documents are brought together first.  ``carried`` names, with
    their types, columns of documents to pass on.  With ``errors`` a document
    that can't be parsed has one row, of nulls but for an ``error`` at the end;
    else none.
    """
    parse = "xml" in source.columns
    full = f"doc_id long, {carried + ', ' if carried else ''}{schema}{', error string' if errors else ''}"
    arrow = to_arrow_schema(StructType.fromDDL(full))
    given = 1 + (len(StructType.fromDDL(carried)) if carried else 0)
    blank = len(arrow) - given - 1

    def made(batches):
        held, weight = [], 0
        put = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
        for known, nodes, error in (_parsed if parse else _nodes_of)(batches):
            if error is None:
                tail = (None,) if errors else ()
                held += [(*known, *row, *tail) for row in rows(Tree(nodes))]
            elif errors:
                held.append((*known, *(None,) * blank, error))
            weight += len(nodes) + 1
            if weight > HELD and held:
                yield put()
                held, weight = [], 0
        if held:
            yield put()

    if parse:
        names = [f.name for f in StructType.fromDDL(carried)] if carried else []
        ready = source.select(F.col("doc_id").cast("long"), *names, "xml")
    else:
        ready = source.select("doc_id", "pre", "end", "parent", "depth", "tag", "attrs", "text").repartition("doc_id").sortWithinPartitions("doc_id", "pre")
    return ready.mapInArrow(made, full)
