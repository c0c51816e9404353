"""RDF payloads whose nested markup Spark has no reader for: RDF/XML and JSON-LD, with sniffing."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import kept
from ..schemas import QUAD
from .readers import broken_ntriples, parse_ntriples

_NS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_RDF = "{" + _NS + "}"
_XML = "{http://www.w3.org/XML/1998/namespace}"
_XSD = "http://www.w3.org/2001/XMLSchema#"
_TYPE, _FIRST, _REST, _NIL = _NS + "type", _NS + "first", _NS + "rest", _NS + "nil"
# fixed values: the names that the syntax keeps for itself
_NO_NODE = {"RDF", "ID", "about", "bagID", "parseType", "resource", "nodeID", "datatype", "li", "aboutEach", "aboutEachPrefix"}
_NO_PROPERTY = {"Description", "RDF", "ID", "about", "bagID", "parseType", "resource", "nodeID", "datatype", "aboutEach", "aboutEachPrefix"}
_SYNTAX = {"ID", "about", "parseType", "resource", "nodeID", "datatype"}


class _Triples:
    """Collects triples, and names blank nodes apart from those that the text names."""

    def __init__(self, named: set[str]):
        self.rows, self.named, self.made = [], named, 0

    def blank(self) -> tuple[str, str]:
        self.made += 1
        while f"b{self.made}" in self.named:
            self.made += 1
        return f"b{self.made}", "BNode"

    def add(self, s: tuple, p: str, o: tuple, datatype: str | None = None, lang: str | None = None) -> None:
        self.rows.append((*s, p, *o, datatype, lang))

    def chain(self, items: list[tuple]) -> tuple[str, str]:
        """The head of a list of (kind, value, datatype, lang) members."""
        nodes = [self.blank() for _ in items]
        for k, (node, (o, datatype, lang)) in enumerate(zip(nodes, items, strict=True)):
            self.add(node, _FIRST, o, datatype, lang)
            self.add(node, _REST, nodes[k + 1] if k + 1 < len(nodes) else (_NIL, "URIRef"))
        return nodes[0] if nodes else (_NIL, "URIRef")


def _iri(tag: str) -> str:
    if not tag.startswith("{"):
        raise ValueError(f"{tag} has no namespace")
    return tag[1:].replace("}", "", 1)


def _own(e: ET.Element, name: str) -> str | None:
    """An attribute of the syntax; old texts write it without its prefix."""
    return e.get(_RDF + name, e.get(name) if name in ("about", "ID", "resource") else None)


def _property_attributes(e: ET.Element) -> list[tuple[str, str]]:
    out = []
    for name, value in e.attrib.items():
        local = name[len(_RDF) :] if name.startswith(_RDF) else None
        if name.startswith(_XML) or local in _SYNTAX or name in ("about", "ID", "resource"):
            continue
        if local in _NO_PROPERTY or local == "li":
            raise ValueError(f"rdf:{local} can't be an attribute")
        out.append((_iri(name), value))
    return out


def _inner_xml(e: ET.Element) -> str:
    out = escape(e.text or "")
    for child in e:
        tail, child.tail = child.tail, None
        out += ET.canonicalize(ET.tostring(child, encoding="unicode")) + escape(tail or "")
        child.tail = tail
    return out


def xml_triples(text: str) -> list[tuple]:
    """(s, s_kind, p, o, o_kind, datatype, lang) of RDF/XML: nodes in properties in nodes.

    Base and language come from the nearest element around that has them. A text that breaks the
    grammar raises.
    """
    root = ET.fromstring(text)
    triples = _Triples({v for e in root.iter() if (v := e.get(_RDF + "nodeID"))})
    resolved = lambda iri, base: urljoin(base, iri) if base else iri
    literal = lambda value: (value, "Literal")

    def scope(e: ET.Element, base: str | None, lang: str | None) -> tuple[str | None, str | None]:
        return resolved(e.get(_XML + "base", base), base), (e.get(_XML + "lang", lang) or None)

    def attributes(s: tuple, e: ET.Element, base: str | None, lang: str | None) -> None:
        for p, value in _property_attributes(e):
            triples.add(s, p, (resolved(value, base), "URIRef") if p == _TYPE else literal(value), None, None if p == _TYPE else lang)

    def node(e: ET.Element, base: str | None, lang: str | None) -> tuple[str, str]:
        base, lang = scope(e, base, lang)
        if e.tag.startswith(_RDF) and e.tag[len(_RDF) :] in _NO_NODE:
            raise ValueError(f"{e.tag} can't be a node")
        about, made_id, blank = _own(e, "about"), _own(e, "ID"), e.get(_RDF + "nodeID")
        if sum(x is not None for x in (about, made_id, blank)) > 1:
            raise ValueError("a node has two names")
        s = (resolved(about, base), "URIRef") if about is not None else (resolved("#" + made_id, base), "URIRef") if made_id is not None else (blank, "BNode") if blank is not None else triples.blank()
        if e.tag != _RDF + "Description":
            triples.add(s, _TYPE, (_iri(e.tag), "URIRef"))
        attributes(s, e, base, lang)
        if (e.text or "").strip() or any((p.tail or "").strip() for p in e):
            raise ValueError("text between properties")
        members(s, e, base, lang)
        return s

    def members(s: tuple, e: ET.Element, base: str | None, lang: str | None) -> None:
        numbered = 0
        for prop in e:
            if prop.tag == _RDF + "li":
                numbered += 1
                property_(s, f"{_NS}_{numbered}", prop, base, lang)
            elif prop.tag.startswith(_RDF) and prop.tag[len(_RDF) :] in _NO_PROPERTY:
                raise ValueError(f"{prop.tag} can't be a property")
            else:
                property_(s, _iri(prop.tag), prop, base, lang)

    def property_(s: tuple, p: str, e: ET.Element, base: str | None, lang: str | None) -> None:
        base, lang = scope(e, base, lang)
        kind, inner, datatype = e.get(_RDF + "parseType"), list(e), e.get(_RDF + "datatype")
        target, blank = _own(e, "resource"), e.get(_RDF + "nodeID")
        content = (e.text or "") + "".join(c.tail or "" for c in inner)
        own_lang = None
        if kind is not None and (target is not None or blank is not None or datatype is not None):
            raise ValueError("parseType beside another object")
        if kind == "Resource":
            o = triples.blank()
            members(o, e, base, lang)
        elif kind == "Collection":
            o = triples.chain([(node(c, base, lang), None, None) for c in inner])
        elif kind is not None:
            o, datatype = literal(_inner_xml(e)), _NS + "XMLLiteral"
        elif target is not None or blank is not None or (not inner and not content and datatype is None and _property_attributes(e)):
            if inner or content.strip() or (target is not None and blank is not None):
                raise ValueError("a property has two objects")
            o = (resolved(target, base), "URIRef") if target is not None else (blank, "BNode") if blank is not None else triples.blank()
            attributes(o, e, base, lang)
        elif inner:
            if len(inner) > 1 or content.strip() or datatype is not None:
                raise ValueError("a property has two objects")
            o = node(inner[0], base, lang)
        else:
            o, own_lang = literal(content), None if datatype else lang
            if _property_attributes(e):
                raise ValueError("text beside property attributes")
        datatype = resolved(datatype, base) if datatype else None
        triples.add(s, p, o, datatype, own_lang)
        if (made_id := _own(e, "ID")) is not None:
            statement = (resolved("#" + made_id, base), "URIRef")
            triples.add(statement, _TYPE, (_NS + "Statement", "URIRef"))
            triples.add(statement, _NS + "subject", s)
            triples.add(statement, _NS + "predicate", (p, "URIRef"))
            triples.add(statement, _NS + "object", o, datatype, own_lang)

    if root.tag == _RDF + "RDF":
        base, lang = scope(root, None, None)
        for e in root:
            node(e, base, lang)
    else:
        node(root, None, None)
    return triples.rows


_KNOWN = {"@id", "@type", "@context", "@graph", "@index", "@reverse", "@included"}


def _double(x: float) -> str:
    mantissa, exponent = f"{x:.15E}".split("E")
    return f"{mantissa.rstrip('0').rstrip('.') + ('.0' if '.' not in mantissa.rstrip('0').rstrip('.') else '')}E{int(exponent)}"


class _Context:
    """The terms of a JSON-LD context that stands in the text."""

    def __init__(self, terms: dict | None = None, vocab: str | None = None, base: str | None = None, lang: str | None = None):
        self.terms, self.vocab, self.base, self.lang = terms or {}, vocab, base, lang

    def and_(self, more) -> _Context:
        """This context with another over it."""
        out = _Context(dict(self.terms), self.vocab, self.base, self.lang)
        for c in more if isinstance(more, list) else [more]:
            if c is None:
                out = _Context()
                continue
            if not isinstance(c, dict) or set(c) & {"@import", "@propagate", "@protected"}:
                raise ValueError("a context that isn't in the text")
            out.vocab, out.base, out.lang = c.get("@vocab", out.vocab), c.get("@base", out.base), c.get("@language", out.lang)
            out.terms.update({k: v for k, v in c.items() if not k.startswith("@")})
        return out

    def term(self, key: str) -> dict:
        found = self.terms.get(key)
        return found if isinstance(found, dict) else {}

    def iri(self, key: str, seen: frozenset = frozenset()) -> str | None:
        """A predicate, type or prefixed name as a full IRI; None for a term that nothing defines."""
        if key.startswith("@"):
            return key
        found = self.terms.get(key, False)
        if found is None:
            return None
        named = found if isinstance(found, str) else found.get("@id", found.get("@reverse")) if found else None
        if named is not None and key not in seen and named != key:
            return self.iri(named, seen | {key})
        prefix, colon, rest = key.partition(":")
        if colon and not rest.startswith("//") and prefix in self.terms and prefix not in seen:
            return (self.iri(prefix, seen | {key}) or prefix) + rest
        return key if colon else None if self.vocab is None else self.vocab + key

    def node(self, name: str) -> tuple[str, str]:
        if name.startswith("_:"):
            return name[2:], "BNode"
        prefix, colon, rest = name.partition(":")
        full = self.iri(name) if colon and prefix in self.terms and not rest.startswith("//") else name
        return (urljoin(self.base, full) if self.base else full), "URIRef"


def jsonld_triples(text: str) -> list[tuple]:
    """The same of JSON-LD, expanded or with a context in the text: nodes in nodes, lists, sets, single values.

    Terms that the context doesn't define are no data, as the format has it. A context elsewhere,
    an unknown keyword or a value of no known shape raises.
    """
    data = json.loads(text)
    if not isinstance(data, (dict, list)):
        raise ValueError("no node")
    triples = _Triples(set(re.findall(r'"_:([^"]*)"', text)))

    def node(item: dict, context: _Context) -> tuple[str, str]:
        if not isinstance(item, dict):
            raise ValueError("a node is no object")
        if "@context" in item:
            context = context.and_(item["@context"])
        keys = {k: context.iri(k) for k in item}
        by_name = {v: item[k] for k, v in keys.items() if v and v.startswith("@")}
        if unknown := set(by_name) - _KNOWN:
            raise ValueError(f"unknown {sorted(unknown)[0]}")
        s = context.node(by_name["@id"]) if "@id" in by_name else triples.blank()
        types = by_name.get("@type", [])
        for t in [types] if isinstance(types, str) else types:
            full = context.iri(t) or t
            triples.add(s, _TYPE, (full[2:], "BNode") if full.startswith("_:") else (full, "URIRef"))
        for inside in [*_many(by_name.get("@graph", [])), *_many(by_name.get("@included", []))]:
            node(inside, context)
        for p, found in by_name.get("@reverse", {}).items():
            for v in _many(found):
                triples.add(node(v, context), context.iri(p) or p, s)
        for key, p in keys.items():
            if p is None or p.startswith("@"):
                continue
            if p.startswith("_:"):
                raise ValueError("a blank predicate")
            for o, datatype, lang in values(item[key], context.term(key), context):
                if "@reverse" in context.term(key):
                    triples.add(o, p, s)
                else:
                    triples.add(s, p, o, datatype, lang)
        return s

    def values(found, term: dict, context: _Context) -> list[tuple]:
        container = term.get("@container")
        if container == "@language" and isinstance(found, dict):
            return [((v, "Literal"), None, None if lang in ("@none", "none") else lang) for lang, many in found.items() for v in _many(many) if v is not None]
        if container == "@index" and isinstance(found, dict):
            found = [v for many in found.values() for v in _many(many)]
        elif container not in (None, "@set", "@list", "@language", "@index"):
            raise ValueError(f"container {container}")
        if container == "@list" and not (isinstance(found, dict) and "@list" in found):
            return [(triples.chain([x for v in _many(found) for x in value(v, term, context)]), None, None)]
        return [x for v in _many(found) for x in value(v, term, context)]

    def value(v, term: dict, context: _Context) -> list[tuple]:
        kind = term.get("@type")
        if v is None:
            return []
        if isinstance(v, dict):
            if "@list" in v:
                return [(triples.chain([x for y in _many(v["@list"]) for x in value(y, term, context)]), None, None)]
            if "@set" in v:
                return [x for y in _many(v["@set"]) for x in value(y, term, context)]
            if "@value" in v:
                if unknown := set(v) - {"@value", "@type", "@language", "@index", "@direction"}:
                    raise ValueError(f"{sorted(unknown)[0]} beside @value")
                datatype = v.get("@type")
                return [] if v["@value"] is None else [_literal(v["@value"], (context.iri(datatype) or datatype) if datatype else None, v.get("@language"))]
            return [(node(v, context), None, None)]
        if isinstance(v, list):
            raise ValueError("a list in a list")
        if isinstance(v, str) and kind in ("@id", "@vocab"):
            full = context.iri(v) if kind == "@vocab" else None
            return [((full, "URIRef") if full else context.node(v), None, None)]
        if kind and not kind.startswith("@"):
            return [_literal(v, context.iri(kind) or kind, None)]
        return [_literal(v, None, term.get("@language", context.lang) if isinstance(v, str) else None)]

    for item in _many(data):
        if isinstance(item, dict) and "@graph" in item and not set(item) - {"@graph", "@context"}:
            context = _Context().and_(item.get("@context", {}))
            for inside in _many(item["@graph"]):
                node(inside, context)
        else:
            node(item, _Context())
    return triples.rows


def _many(v) -> list:
    return v if isinstance(v, list) else [v]


def _literal(v, datatype: str | None, lang: str | None) -> tuple:
    if isinstance(v, bool):
        return (str(v).lower(), "Literal"), datatype or _XSD + "boolean", None
    if isinstance(v, float) and not (v.is_integer() and abs(v) < 1e21 and datatype is None):
        return (_double(v), "Literal"), datatype or _XSD + "double", None
    if isinstance(v, (int, float)):
        return (str(int(v)), "Literal"), datatype or _XSD + "integer", None
    if not isinstance(v, str):
        raise ValueError("a value of no known shape")
    return (v, "Literal"), datatype, lang


def parse_rdf_payload(df: DataFrame, col: str, graph_col: str) -> tuple[DataFrame, DataFrame]:
    """(quads, errors) of RDF texts: RDF/XML, N-Triples or JSON-LD by their first characters.

    N-Triples stay in the JVM; the others are parsed in batches. A text that fails is a row of
    errors (graph, error) as a whole, and so is each line of N-Triples that is no statement,
    comment or blank: no triple goes without one. Nulls and empty texts give nothing.
    """
    # the texts are made once, however often they are looked at
    df = kept(df.select(F.col(graph_col).alias("graph"), F.col(col).alias("text")))
    head = F.ltrim(F.substring("text", 1, 200))
    kind = F.when(head.contains("<rdf:RDF") | head.startswith("<?xml"), "xml").when(head.startswith("<") | head.startswith("_:"), "nt").otherwise("json")
    rows = df.filter(F.col("text").isNotNull() & (F.trim("text") != "")).select("graph", "text", kind.alias("kind"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for graph, text, k in zip(pdf["graph"], pdf["text"], pdf["kind"], strict=True):
                try:
                    out += [(graph, *t, None) for t in dict.fromkeys(xml_triples(text) if k == "xml" else jsonld_triples(text))]
                except Exception as e:  # the record's fault, kept as a row
                    out.append((graph, *[None] * 7, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[*QUAD, "error"], dtype=object)

    # parsed once, for quads and errors
    nested = kept(rows.filter("kind <> 'nt'").mapInPandas(run, ", ".join(f"{c} string" for c in [*QUAD, "error"])))
    statements = rows.filter("kind = 'nt'")
    flat = parse_ntriples(statements, "text", "graph").dropDuplicates()
    errors = nested.filter("error is not null").select("graph", "error").unionByName(broken_ntriples(statements, "text", "graph"))
    return nested.filter("error is null").select(*QUAD).unionByName(flat), errors
