"""JSON-LD documents as triples: terms are expanded by their contexts, and nodes without an id get blank-node labels.

What is read: inline contexts (also lists and nested ones, ``@base``, ``@vocab``, ``@language``, prefixes, term definitions with
``@id``, ``@type``, ``@language``, ``@container`` and ``@reverse``), keyword aliases, ``@graph`` of the default graph, ``@reverse``, ``@list``, ``@set``,
``@included``, language and index maps, typed values. Contexts that would have to be fetched, and named graphs, are errors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urljoin

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"


def listed(value) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


class Context:
    """What terms stand for; ``within`` gives the context inside a nested one."""

    def __init__(self, terms: dict[str, dict], base: str = "", vocab: str | None = None, language: str | None = None):
        self.terms, self.base, self.vocab, self.language = terms, base, vocab, language
        self.done: set[str] = set()  # terms that the context in hand has defined

    def within(self, given) -> Context:
        if given is None:
            return Context({}, "")
        found = self
        for part in given if isinstance(given, list) else [given]:
            if part is None:
                found = Context({}, "")
                continue
            if not isinstance(part, dict):
                raise ValueError(f"a context that would have to be fetched: {part}")
            base = urljoin(found.base, part["@base"]) if part.get("@base") else "" if "@base" in part else found.base
            found = Context(dict(found.terms), base, part.get("@vocab", found.vocab), part.get("@language", found.language))
            if found.vocab is not None and not found.vocab.startswith("_:"):
                found.vocab = found.iri(found.vocab, part) if ":" in found.vocab else found.vocab
            for term, definition in part.items():
                if not term.startswith("@"):
                    found.define(term, part, ())
        return found

    def define(self, term: str, given: dict, open_terms: tuple) -> None:
        """Define ``term``; definitions of the same context that it builds on come first."""
        if term in self.done:
            return
        if term in open_terms:
            raise ValueError(f"cyclic definition of {term}")
        definition = given[term]
        if definition is None:
            self.terms[term] = {"id": None}
            self.done.add(term)
            return
        if isinstance(definition, str):
            definition = {"@id": definition}
        about = definition.get("@reverse", definition.get("@id", term))
        path = (*open_terms, term)
        self.terms.pop(term, None)
        made = {"id": about and self.iri(about, given, path, own=term), "reverse": "@reverse" in definition, "container": listed(definition.get("@container"))}
        if "@type" in definition:
            made["type"] = self.iri(definition["@type"], given, path)
        if "@language" in definition:
            made["language"] = definition["@language"]
        if "@context" in definition:
            made["context"] = definition["@context"]
        self.terms[term] = made
        self.done.add(term)

    def iri(self, name: str, given: dict | None = None, path: tuple = (), own: str | None = None, vocab: bool = True) -> str | None:
        """The IRI or keyword that ``name`` stands for, as a term (``vocab``) or as a document-relative reference."""
        if name.startswith("@"):
            return name
        if vocab and given and name != own and name in given:
            self.define(name, given, path)
        if vocab and name != own and name in self.terms:
            return self.terms[name]["id"]
        if ":" in name:
            prefix, local = name.split(":", 1)
            if prefix == "_" or local.startswith("//"):
                return name
            if given and prefix in given:
                self.define(prefix, given, path)
            if prefix in self.terms and self.terms[prefix]["id"]:
                return self.terms[prefix]["id"] + local
            return name
        if vocab:
            return self.vocab + name if self.vocab is not None else None
        return urljoin(self.base, name)


class Document:
    def __init__(self):
        self.count = 0
        self.prefixes: dict[str, str] = {}

    def fresh(self) -> tuple[str, str]:
        self.count += 1
        return f"b{self.count}", "bnode"

    def reference(self, name: str | None) -> tuple[str, str] | None:
        if name is None or name.startswith("@"):
            return None
        return (f"n{name[2:]}", "bnode") if name.startswith("_:") else (name, "iri")

    def note(self, context: Context) -> None:
        """Terms that end like namespaces are the document's prefixes."""
        for term, made in context.terms.items():
            if made["id"] and made["id"][-1:] in "/#:?" and not made.get("type") and not made.get("reverse"):
                self.prefixes.setdefault(term, made["id"])
        if context.vocab:
            self.prefixes.setdefault("", context.vocab)

    def node(self, value: dict, context: Context, known=None) -> Iterator[tuple]:
        """Triples of a node object; its name is ``known`` or found by ``name_of``."""
        if "@context" in value:
            context = context.within(value["@context"])
            self.note(context)
        subject = known or self.name_of(value, context)
        fields = [(context.iri(key), key, item) for key, item in value.items() if key != "@context"]
        for word, _, item in fields:
            if word == "@type":
                for kind in listed(item):
                    target = self.reference(context.iri(kind) or context.iri(kind, vocab=False))
                    if target:
                        yield (*subject, RDF + "type", *target, None, None)
        for word, key, item in fields:
            if word == "@graph":
                if any(w for w, _, _ in fields if w != "@graph"):
                    raise ValueError("named graphs are not supported")
                for part in listed(item):
                    yield from self.node(part, context)
            elif word == "@included":
                for part in listed(item):
                    yield from self.node(part, context)
            elif word == "@reverse":
                for name, parts in item.items():
                    yield from self.reversed(subject, context.iri(name), listed(parts), context)
            elif word and not word.startswith("@"):
                made = context.terms.get(key, {})
                inner = context.within(made["context"]) if "context" in made else context
                if made.get("reverse"):
                    yield from self.reversed(subject, word, listed(item), inner)
                elif ":" in word:
                    yield from self.objects(subject, word, item, inner, made)

    def name_of(self, value: dict, context: Context) -> tuple[str, str]:
        if "@context" in value:
            context = context.within(value["@context"])
        for key, item in value.items():
            if key != "@context" and context.iri(key) == "@id" and isinstance(item, str):
                return self.reference(context.iri(item, vocab=False)) or self.fresh()
        return self.fresh()

    def reversed(self, subject, predicate, parts, context) -> Iterator[tuple]:
        for part in parts:
            if isinstance(part, str):
                part = {"@id": part}
            known = self.name_of(part, context)
            yield (*known, predicate, *subject, None, None)
            yield from self.node(part, context, known)

    def objects(self, subject, predicate, value, context, made) -> Iterator[tuple]:
        """Links of ``subject`` to what ``value`` holds."""
        container = made.get("container", [])
        if isinstance(value, dict) and "@language" in container:
            for language, texts in value.items():
                for text in listed(texts):
                    if text is not None:
                        yield (*subject, predicate, text, "literal", None if context.iri(language) == "@none" else language, None)
        elif isinstance(value, dict) and {"@index", "@id", "@type"} & set(container):
            how = next(c for c in ("@index", "@id", "@type") if c in container)
            for key, parts in value.items():
                for part in listed(parts):
                    if how != "@index" and context.iri(key) != "@none":
                        part = {how: key, **(part if isinstance(part, dict) else {"@id": part})}
                    yield from self.objects(subject, predicate, part, context, {**made, "container": []})
        elif "@list" in container and not (isinstance(value, dict) and any(context.iri(k) == "@list" for k in value)):
            yield from self.collection(subject, predicate, listed(value), context, made)
        else:
            for part in listed(value):
                yield from self.object(subject, predicate, part, context, made)

    def object(self, subject, predicate, value, context, made) -> Iterator[tuple]:
        words = {context.iri(key): key for key in value} if isinstance(value, dict) else {}
        if value is None:
            return
        if isinstance(value, list):
            for part in value:
                yield from self.object(subject, predicate, part, context, made)
        elif "@list" in words:
            yield from self.collection(subject, predicate, listed(value[words["@list"]]), context, made)
        elif "@set" in words:
            yield from self.objects(subject, predicate, value[words["@set"]], context, made)
        elif "@value" in words:
            kind = value.get(words.get("@type"))
            literal = value[words["@value"]]
            if literal is not None:
                yield (*subject, predicate, *self.literal(literal, kind and context.iri(kind), value.get(words.get("@language"))))
        elif isinstance(value, dict):
            known = self.name_of(value, context)
            yield (*subject, predicate, *known, None, None)
            yield from self.node(value, context, known)
        elif isinstance(value, str) and made.get("type") in ("@id", "@vocab"):
            target = (context.iri(value) if made["type"] == "@vocab" else None) or context.iri(value, vocab=False)
            yield (*subject, predicate, *self.reference(target), None, None)
        else:
            kind = made.get("type") if made.get("type") not in ("@id", "@vocab", "@none") else None
            language = made.get("language", context.language) if isinstance(value, str) and not kind else None
            yield (*subject, predicate, *self.literal(value, kind, language))

    def literal(self, value, kind: str | None, language: str | None) -> tuple:
        """(text, 'literal', language, datatype); numbers in their canonical forms."""
        if kind == "@json":
            return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False), "literal", None, RDF + "JSON"
        if isinstance(value, bool):
            return ("true" if value else "false"), "literal", None, kind or XSD + "boolean"
        if isinstance(value, float) and (value % 1 or abs(value) >= 1e21) or isinstance(value, (int, float)) and kind == XSD + "double":
            mantissa, exponent = f"{value:.15E}".split("E")
            mantissa = mantissa.rstrip("0")
            return f"{mantissa}{'0' if mantissa.endswith('.') else ''}E{int(exponent)}", "literal", None, kind or XSD + "double"
        if isinstance(value, (int, float)):
            return str(int(value)), "literal", None, kind or XSD + "integer"
        return str(value), "literal", None if kind else language, kind

    def collection(self, subject, predicate, items, context, made) -> Iterator[tuple]:
        inside = {**made, "container": []}
        for item in items:
            cell = self.fresh()
            yield (*subject, predicate, *cell, None, None)
            yield from self.object(cell, RDF + "first", item, context, inside)
            subject, predicate = cell, RDF + "rest"
        yield (*subject, predicate, RDF + "nil", "iri", None, None)


def jsonld_triples(content: bytes, prefix_mark: str = "@prefix") -> Iterator[tuple]:
    """(s, s_kind, p, o, o_kind, lang, datatype) of one document, then its declared prefixes."""
    document = Document()
    for part in listed(json.loads(content.decode("utf-8-sig"))):
        yield from document.node(part, Context({}))
    for prefix, namespace in document.prefixes.items():
        yield prefix, "literal", prefix_mark, namespace, "iri", None, None
