"""Turtle, N3 and N-Triples documents as triples.

One document is read token by token; what is open (property lists, collections) stands on a stack, so that nesting may be of any depth. Of N3
the statements that make plain triples are read: ``=``, ``=>``, ``<=``, ``has``, ``is ... of``, paths with ``!`` and ``^``; formulas and variables
are errors, as they need more than one graph.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
# fixed values: predicates that N3 writes as signs
SIGNS = {"=": "http://www.w3.org/2002/07/owl#sameAs", "=>": "http://www.w3.org/2000/10/swap/log#implies", "<=": "http://www.w3.org/2000/10/swap/log#implies"}
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}

NAME_CHAR = r"(?:[\w:\-\u00b7]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%\-])"
TOKEN = re.compile(
    rf"""
    (?P<space>\s+|\#[^\r\n]*)
  | (?P<iri><(?:[^\x00-\x20<>"{{}}|^`\\]|\\u[0-9A-Fa-f]{{4}}|\\U[0-9A-Fa-f]{{8}})*>)
  | (?P<long>\"\"\"(?:"{{0,2}}(?:[^"\\]|\\.))*\"\"\"|'''(?:'{{0,2}}(?:[^'\\]|\\.))*''')
  | (?P<string>"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*')
  | (?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<blank>_:\w(?:[\w\-\u00b7]|\.+(?=[\w\-\u00b7]))*)
  | (?P<double>[+-]?(?:\d+(?:\.\d*)?|\.\d+)[eE][+-]?\d+)
  | (?P<decimal>[+-]?\d*\.\d+)
  | (?P<integer>[+-]?\d+)
  | (?P<name>(?:[^\W\d_](?:[\w\-\u00b7]|\.+(?=[\w\-\u00b7]))*)?:(?:(?!-){NAME_CHAR}(?:{NAME_CHAR}|\.+(?={NAME_CHAR}))*)?)
  | (?P<word>[^\W\d_]\w*)
  | (?P<sign>\^\^|=>|<=|[\[\](),;.=!^{{}}?])
    """,
    re.VERBOSE | re.DOTALL,
)


def unescaped(text: str) -> str:
    """A string with its escapes resolved."""
    if "\\" not in text:
        return text

    def sign(found):
        mark = found[1]
        return chr(int(mark[1:], 16)) if len(mark) > 1 else ESCAPES.get(mark, mark)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", sign, text, flags=re.DOTALL)


def tokens(text: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of the tokens; raises ValueError with the line where there is none."""
    at = 0
    while at < len(text):
        found = TOKEN.match(text, at)
        if found is None:
            line = text.count("\n", 0, at) + 1
            raise ValueError(f"line {line}: unexpected {text[at : at + 20]!r}")
        if found.lastgroup != "space":
            yield found.lastgroup, found[0]
        at = found.end()


class Document:
    """Triples of one document, in the order of their objects; a link to a blank node comes before what the node has."""

    def __init__(self, text: str, n3: bool = False):
        self.tokens, self.n3 = tokens(text), n3
        self.ahead: list[tuple[str, str]] = []
        self.names: dict[str, str] = {}
        self.first_names: dict[str, str] = {}
        self.base, self.count = "", 0

    def take(self, *wanted: str) -> tuple[str, str]:
        kind, text = self.ahead.pop() if self.ahead else next(self.tokens, ("end", "end of the file"))
        if wanted and kind not in wanted and text not in wanted:
            raise ValueError(f"unexpected {text}; expected {' or '.join(wanted)}")
        return kind, text

    def look(self) -> tuple[str, str]:
        if not self.ahead:
            self.ahead.append(self.take())
        return self.ahead[-1]

    def fresh(self) -> tuple[str, str]:
        self.count += 1
        return f"b{self.count}", "bnode"

    def iri(self, kind: str, text: str) -> str:
        if kind == "iri":
            return urljoin(self.base, unescaped(text[1:-1]))
        prefix, local = text.split(":", 1)
        if prefix not in self.names:
            raise ValueError(f"undeclared prefix {prefix}:")
        return self.names[prefix] + re.sub(r"\\(.)", r"\1", local)

    def directive(self, word: str) -> None:
        if word.lower().endswith("prefix"):
            prefix = self.take("name")[1]
            if not prefix.endswith(":"):
                raise ValueError(f"unexpected {prefix}; expected a prefix")
            self.names[prefix[:-1]] = self.iri(*self.take("iri"))
            self.first_names.setdefault(prefix[:-1], self.names[prefix[:-1]])
        else:
            self.base = self.iri(*self.take("iri"))
        if word.startswith("@"):
            self.take(".")

    def term(self, kind: str, text: str) -> tuple:
        """(value, kind, language, datatype) of a term that is one token, or a literal with its language or type."""
        if kind in ("iri", "name"):
            return self.iri(kind, text), "iri", None, None
        if kind == "blank":
            return f"n{text[2:]}", "bnode", None, None
        if kind in ("integer", "decimal", "double"):
            return text, "literal", None, XSD + kind
        if kind == "word" and text in ("true", "false"):
            return text, "literal", None, XSD + "boolean"
        if kind in ("string", "long"):
            value = unescaped(text[1:-1] if kind == "string" else text[3:-3])
            following = self.look()
            if following[0] == "at":
                return value, "literal", self.take()[1][1:], None
            if following[1] == "^^":
                self.take()
                return value, "literal", None, self.iri(*self.take("iri", "name"))
            return value, "literal", None, None
        raise ValueError(f"unexpected {text}; expected a term")

    def predicate(self, kind: str, text: str) -> tuple[str, bool]:
        """(predicate, whether subject and object are exchanged)"""
        if text == "a":
            return RDF + "type", False
        if self.n3 and text in SIGNS:
            return SIGNS[text], text == "<="
        if self.n3 and text == "has":
            return self.predicate(*self.take())
        if self.n3 and text == "is":
            found = self.predicate(*self.take())[0]
            self.take("of")
            return found, True
        if kind not in ("iri", "name"):
            raise ValueError(f"unexpected {text}; expected a predicate")
        return self.iri(kind, text), False

    def triples(self) -> Iterator[tuple]:
        subject = predicate = None  # of the statement that is read; predicate: (IRI, whether exchanged)
        wanted = "subject"  # or predicate, object, item (of a collection), after (an object), or node (after a property list as subject)
        stack: list[tuple] = []  # what surrounds an open bracket: (its closing sign, subject, predicate, wanted)

        def triple(s, p, o):
            (p, exchanged), o = p, (*o, None, None)[:4]
            if exchanged:
                s, o = o[:2], (*s[:2], None, None)
            if s[1] == "literal":
                raise ValueError("a literal can't be a subject")
            return s[0], s[1], p, *o

        while True:
            kind, text = self.take()
            if kind == "end":
                if stack or wanted != "subject":
                    raise ValueError("unexpected end of the file")
                return
            if text in ("{", "?"):
                raise ValueError("formulas and variables are not supported")
            if wanted == "subject" and not stack and (kind == "at" or kind == "word" and text.lower() in ("prefix", "base")):
                if text not in ("@prefix", "@base") and text.startswith("@"):
                    raise ValueError(f"unexpected {text}")
                self.directive(text)
            elif wanted in ("predicate", "node", "after") and text in (".", "]", ";", ","):
                if wanted == "node" and text != "." or wanted == "predicate" and text == "," or text == "." and stack or text == "]" and not (stack and stack[-1][0] == "]"):
                    raise ValueError(f"unexpected {text}")
                if text == ".":
                    if wanted == "predicate" and predicate is None:
                        raise ValueError("a statement without a predicate")
                    subject = predicate = None
                    wanted = "subject"
                elif text == "]":
                    node = subject
                    _, subject, predicate, wanted = stack.pop()
                    if wanted == "subject":
                        subject, wanted = node, "node"
                elif text == ";":
                    wanted = "predicate"
                else:
                    wanted = "object"
            elif wanted in ("predicate", "node"):
                predicate, wanted = self.predicate(kind, text), "object"
            elif wanted == "item" and text == ")":
                cell = subject
                _, subject, predicate, wanted = stack.pop()
                if wanted == "collection":  # it was the subject of a statement
                    wanted = "predicate"
                    head, predicate = subject, None
                    if cell is None:
                        subject = (RDF + "nil", "iri")
                    else:
                        subject = head
                        yield triple(cell, (RDF + "rest", False), (RDF + "nil", "iri"))
                elif cell is None:
                    yield triple(subject, predicate, (RDF + "nil", "iri"))
                else:
                    yield triple(cell, (RDF + "rest", False), (RDF + "nil", "iri"))
            elif wanted in ("subject", "object", "item"):
                if wanted == "item":  # a new cell, linked to the one before or to the statement around the collection
                    cell = self.fresh()
                    closing, outer, link, then = stack[-1]
                    if subject is not None:
                        yield triple(subject, (RDF + "rest", False), cell)
                    elif then == "collection":
                        stack[-1] = (closing, cell, link, then)
                    else:
                        yield triple(outer, link, cell)
                    subject, predicate = cell, (RDF + "first", False)
                after = "predicate" if wanted == "subject" else "item" if wanted == "item" else "after"
                if text == "[":
                    node = self.fresh()
                    if wanted != "subject":
                        yield triple(subject, predicate, node)
                    if self.look()[1] == "]":
                        self.take()
                        subject, wanted = (node if wanted == "subject" else subject), "node" if wanted == "subject" else after
                    else:
                        stack.append(("]", subject, predicate, "subject" if wanted == "subject" else after))
                        subject, predicate, wanted = node, None, "predicate"
                elif text == "(":
                    stack.append((")", subject, predicate, "collection" if wanted == "subject" else after))
                    subject, predicate, wanted = None, None, "item"
                else:
                    value = self.term(kind, text)
                    while self.n3 and self.look()[1] in ("!", "^"):  # a path: a node that the value leads to, or that leads to it
                        forward, node = self.take()[1] == "!", self.fresh()
                        step = (self.predicate(*self.take())[0], not forward)
                        yield triple(value, step, node)
                        value = (*node, None, None)
                    if wanted == "subject":
                        subject, predicate = value[:2], None
                        if value[1] == "literal" and not self.n3:
                            raise ValueError("a literal can't be a subject")
                    else:
                        yield triple(subject, predicate, value)
                    wanted = after
            else:
                raise ValueError(f"unexpected {text}")


def turtle_triples(content: bytes, n3: bool = False, prefix_mark: str = "@prefix") -> Iterator[tuple]:
    """(s, s_kind, p, o, o_kind, lang, datatype) of one document, then its declared prefixes."""
    document = Document(content.decode("utf-8-sig"), n3)
    yield from document.triples()
    for prefix, namespace in document.first_names.items():
        yield prefix, "literal", prefix_mark, namespace, "iri", None, None
