"""Text operands of PDF pages, read and rewritten with the standard library.

The file's objects are read one by one (those in object streams too), pages are walked in order, and their
content streams are cut into operators.  Each string of ``Tj`` and ``TJ`` is a block of its own, so a value
that is split over operands is not seen whole.  Rewriting writes all objects anew: nothing of the old
content streams is left in the file.  Encrypted files, and streams with filters other than Flate, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from .office import BadDocument, Rewrite

_BLANK = b"\0\t\n\x0c\r "
_DELIMITER = b"()<>[]{}/%"
_REGULAR = re.compile(rb"[^\0\t\n\x0c\r ()<>\[\]{}/%]+")
_SKIP = re.compile(rb"(?:[\0\t\n\x0c\r ]+|%[^\r\n]*)*")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\x0c"}


class Name(bytes):
    pass


class Word(bytes):
    """An operator, a number or a keyword, as it is written."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    head: dict
    data: bytes


class Tokens:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = _SKIP.match(self.data, self.at).end()

    def value(self, references: bool = True):
        """The next object, or None at the end."""
        self.skip()
        d, at = self.data, self.at
        if at >= len(d):
            return None
        c = d[at : at + 1]
        if c == b"(":
            return self._literal()
        if d[at : at + 2] == b"<<":
            self.at += 2
            out: dict = {}
            while True:
                self.skip()
                if self.data[self.at : self.at + 2] == b">>":
                    self.at += 2
                    return out
                key, value = self.value(references), self.value(references)
                if not isinstance(key, Name):
                    raise BadDocument("a dictionary without names")
                out[key] = value
        if c == b"<":
            end = d.index(b">", at)
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            items: list = []
            while True:
                self.skip()
                if self.data[self.at : self.at + 1] in (b"]", b""):
                    self.at += 1
                    return items
                items.append(self.value(references))
        if c == b"/":
            m = _REGULAR.match(d, at + 1)
            self.at = m.end() if m else at + 1
            return Name(d[at + 1 : self.at])
        m = _REGULAR.match(d, at)
        if not m:
            self.at += 1
            return Word(c)
        self.at = m.end()
        if references and m[0].isdigit() and (r := re.compile(rb"[\0\t\n\x0c\r ]+\d+[\0\t\n\x0c\r ]+R(?![^\0\t\n\x0c\r ()<>\[\]{}/%])").match(d, self.at)):
            self.at = r.end()
            return Ref(int(m[0]))
        return Word(m[0])

    def _literal(self) -> bytes:
        d, at, depth, out = self.data, self.at + 1, 1, bytearray()
        while at < len(d):
            c = d[at : at + 1]
            if c == b"\\":
                n = d[at + 1 : at + 2]
                octal = re.compile(rb"[0-7]{1,3}").match(d, at + 1)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    at = octal.end()
                elif n in b"\r\n":
                    at += 3 if d[at + 1 : at + 3] == b"\r\n" else 2
                else:
                    out += _ESCAPES.get(n, n)
                    at += 2
                continue
            depth += (c == b"(") - (c == b")")
            at += 1
            if not depth:
                break
            out += c
        self.at = at
        return bytes(out)


def written(value) -> bytes:
    if isinstance(value, dict):
        return b"<<" + b" ".join(b"/" + k + b" " + written(v) for k, v in value.items()) + b">>"
    if isinstance(value, list):
        return b"[" + b" ".join(map(written, value)) + b"]"
    if isinstance(value, Name):
        return b"/" + value
    if isinstance(value, Word):
        return bytes(value)
    if isinstance(value, Ref):
        return b"%d 0 R" % value.number
    if isinstance(value, bytes):
        return b"<" + value.hex().encode() + b">"
    return b"null"


def decoded(raw: bytes) -> str:
    if raw.startswith(b"\xfe\xff"):
        return raw[2:].decode("utf-16-be", "replace")
    if raw.startswith(b"\xff\xfe"):
        return raw[2:].decode("utf-16-le", "replace")
    return raw.decode("latin-1")


def encoded(text: str, like: bytes) -> bytes:
    if like.startswith(b"\xff\xfe"):
        return b"\xff\xfe" + text.encode("utf-16-le")
    try:
        return text.encode("latin-1") if not like.startswith(b"\xfe\xff") else b"\xfe\xff" + text.encode("utf-16-be")
    except UnicodeEncodeError:
        return b"\xfe\xff" + text.encode("utf-16-be")


class Document:
    def __init__(self, data: bytes) -> None:
        if b"%PDF-" not in data[:1024]:
            raise BadDocument("not a PDF")
        self.objects: dict[int, object] = {}
        self.trailer: dict = {}
        at = 0
        start = re.compile(rb"(?<![^\0\t\n\x0c\r ])(\d+)[\0\t\n\x0c\r ]+\d+[\0\t\n\x0c\r ]+obj(?![A-Za-z])|(?<![A-Za-z])trailer(?![A-Za-z])")
        while m := start.search(data, at):
            tokens = Tokens(data, m.end())
            value = tokens.value()
            at = tokens.at
            if m[1] is None:
                self.trailer |= value if isinstance(value, dict) else {}
                continue
            tokens.skip()
            if isinstance(value, dict) and data[tokens.at : tokens.at + 6] == b"stream":
                begin = tokens.at + 6
                begin += 2 if data[begin : begin + 2] == b"\r\n" else 1
                length = value.get(Name(b"Length"))
                end = begin + int(length) if isinstance(length, Word) and length.isdigit() else -1
                if end < 0 or not data[end : end + 12].lstrip(_BLANK).startswith(b"endstream"):
                    end = data.find(b"endstream", begin)
                    if end < 0:
                        raise BadDocument("a stream without end")
                    end -= data[end - 2 : end] == b"\r\n" or data[end - 1 : end] in (b"\n", b"\r")
                value = Stream(value, data[begin:end])
                at = end
                if value.head.get(Name(b"Type")) == b"XRef":
                    self.trailer |= {k: v for k, v in value.head.items() if k in (b"Root", b"Info", b"ID", b"Encrypt")}
            self.objects[int(m[1])] = value
        if Name(b"Encrypt") in self.trailer:
            raise BadDocument("the PDF is encrypted")
        for number, value in list(self.objects.items()):
            if isinstance(value, Stream) and value.head.get(Name(b"Type")) == b"ObjStm":
                body = self.expanded(value)
                tokens = Tokens(body)
                pairs = [(int(tokens.value(False)), int(tokens.value(False))) for _ in range(int(self.at(value.head[Name(b"N")])))]
                first = int(self.at(value.head[Name(b"First")]))
                for n, offset in pairs:
                    self.objects.setdefault(n, Tokens(body, first + offset).value())
                del self.objects[number]
            elif isinstance(value, Stream) and value.head.get(Name(b"Type")) == b"XRef":
                del self.objects[number]

    def at(self, value):
        seen = 0
        while isinstance(value, Ref) and seen < 50:
            value, seen = self.objects.get(value.number), seen + 1
        return value

    def expanded(self, stream: Stream) -> bytes:
        filters = self.at(stream.head.get(Name(b"Filter"))) or []
        data = stream.data
        for f in filters if isinstance(filters, list) else [filters]:
            if self.at(f) not in (b"FlateDecode", b"Fl"):
                raise BadDocument(f"filter {self.at(f)!r} is not read")
            data = zlib.decompressobj().decompress(data)
        return data

    def pages(self) -> Iterator[dict]:
        root = self.at(self.trailer.get(Name(b"Root"))) or next((o for o in self.objects.values() if isinstance(o, dict) and o.get(Name(b"Type")) == b"Catalog"), None)
        if not isinstance(root, dict):
            raise BadDocument("no catalogue")
        todo, seen = [root.get(Name(b"Pages"))], set()
        while todo:
            ref = todo.pop()
            if isinstance(ref, Ref):
                if ref.number in seen:
                    continue
                seen.add(ref.number)
            node = self.at(ref)
            if not isinstance(node, dict):
                continue
            if Name(b"Kids") in node:
                todo += reversed(self.at(node[Name(b"Kids")]))
            else:
                yield node

    def contents(self, page: dict) -> bytes | None:
        value = self.at(page.get(Name(b"Contents")))
        streams = [self.at(v) for v in value] if isinstance(value, list) else [value]
        parts = [self.expanded(s) for s in streams if isinstance(s, Stream)]
        return b"\n".join(parts) if parts else None

    def saved(self) -> bytes:
        out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
        for n, value in sorted(self.objects.items()):
            places[n] = len(out)
            if isinstance(value, Stream):
                head = value.head | {Name(b"Length"): Word(b"%d" % len(value.data))}
                out += b"%d 0 obj\n" % n + written(head) + b"\nstream\n" + value.data + b"\nendstream\nendobj\n"
            else:
                out += b"%d 0 obj\n" % n + written(value) + b"\nendobj\n"
        size, start = max(places, default=0) + 1, len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % size
        out += b"".join(b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 65535 f \n" for n in range(1, size))
        trailer = {k: v for k, v in self.trailer.items() if k in (b"Root", b"Info", b"ID")} | {Name(b"Size"): Word(b"%d" % size)}
        return bytes(out + b"trailer\n" + written(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % start)


def operations(content: bytes) -> list[tuple[list, bytes, bytes | None]]:
    """(operands, operator, raw inline image or None) in order."""
    tokens, out, operands = Tokens(content), [], []
    number = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)").fullmatch
    while (v := tokens.value(False)) is not None:
        if type(v) is Word and not number(v) and v not in (b"true", b"false", b"null"):
            if v == b"BI":
                end = re.compile(rb"[\0\t\n\x0c\r ]EI(?=[\0\t\n\x0c\r ]|$)").search(content, tokens.at)
                stop = end.end() if end else len(content)
                out.append(([], b"INLINE IMAGE", b"BI" + content[tokens.at : stop]))
                tokens.at = stop
            else:
                out.append((operands, bytes(v), None))
            operands = []
        else:
            operands.append(v)
    return out


def _strings(ops: list, page: int) -> Iterator[tuple[str, list, int]]:
    """(block id, list, place): where each string operand is."""
    for i, (operands, operator, _) in enumerate(ops):
        if operator == b"Tj" and operands and type(operands[0]) is bytes:
            yield f"pdf:{page}:{i}:0", operands, 0
        elif operator == b"TJ" and operands and isinstance(operands[0], list):
            for j, item in enumerate(operands[0]):
                if type(item) is bytes:
                    yield f"pdf:{page}:{i}:{j}", operands[0], j


def read_pdf(data: bytes) -> list[tuple[str, str]]:
    document, out = Document(data), []
    for n, page in enumerate(document.pages()):
        content = document.contents(page)
        if content is not None:
            out += [(block, text) for block, where, j in _strings(operations(content), n) if (text := decoded(where[j])).strip()]
    return out


def rewrite_pdf(data: bytes, rewrite: Rewrite) -> bytes:
    document = Document(data)
    for n, page in enumerate(list(document.pages())):
        content = document.contents(page)
        if content is None:
            continue
        ops = operations(content)
        changed = False
        for block, where, j in _strings(ops, n):
            masked = rewrite(block, decoded(where[j]))
            if masked is not None:
                where[j] = encoded(masked, where[j])
                changed = True
        if changed:
            body = b"\n".join(raw or b" ".join([*map(written, operands), operator]) for operands, operator, raw in ops)
            old = document.at(page[Name(b"Contents")])
            for ref in [page[Name(b"Contents")], *(old if isinstance(old, list) else [])]:
                if isinstance(ref, Ref):
                    document.objects.pop(ref.number, None)
            number = max(document.objects, default=0) + 1
            document.objects[number] = Stream({Name(b"Filter"): Name(b"FlateDecode")}, zlib.compress(body))
            page[Name(b"Contents")] = Ref(number)
    return document.saved()
