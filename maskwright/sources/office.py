"""Word and PowerPoint containers, read and rewritten with the standard library.

A container's blocks are (block id, text); the same walk that finds them rewrites their runs, so ids
mean the same place both times.  Everything but the text of masked runs is kept byte for byte, part by part.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
SPACE = "{http://www.w3.org/XML/1998/namespace}space"
#: What turns a block's text into its masked text; None leaves the block.
Rewrite = Callable[[str, str], str | None]


class BadDocument(ValueError):
    pass


class Package:
    """A zip of XML parts; parts that were changed are written anew, the others are copied."""

    def __init__(self, data: bytes) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise BadDocument("not an Office container") from e
        self.names = set(self.zip.namelist())
        self.parts: dict[str, ET.Element] = {}
        self.changed: set[str] = set()

    def part(self, name: str) -> ET.Element:
        if name not in self.parts:
            if name not in self.names:
                raise BadDocument(f"no part {name}")
            data = self.zip.read(name)
            for prefix, uri in re.findall(rb'xmlns:([\w.-]+)="([^"]+)"', data):
                if not re.fullmatch(rb"ns\d+", prefix):
                    ET.register_namespace(prefix.decode(), uri.decode())
            try:
                self.parts[name] = ET.fromstring(data)
            except ET.ParseError as e:
                raise BadDocument(f"part {name} is not XML") from e
        return self.parts[name]

    def relations(self, name: str) -> dict[str, tuple[str, str]]:
        """Relation id to (kind, part name) of a part."""
        folder, file = posixpath.split(name)
        rels = posixpath.join(folder, "_rels", file + ".rels")
        if rels not in self.names:
            return {}
        out = {}
        for r in self.part(rels).iter(REL + "Relationship"):
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                out[r.get("Id")] = r.get("Type", "").rsplit("/", 1)[-1], target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        return out

    def main(self) -> str:
        for kind, name in self.relations("").values() if "_rels/.rels" in self.names else ():
            if kind == "officeDocument":
                return name
        raise BadDocument("no main part")

    def saved(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for item in self.zip.infolist():
                data = self.zip.read(item)
                if item.filename in self.changed:
                    data = ET.tostring(self.parts[item.filename], encoding="UTF-8", xml_declaration=True)
                z.writestr(item, data)
        return out.getvalue()


# Word

_WORD_CHARACTERS = {W + "tab": "\t", W + "ptab": "\t", W + "cr": "\n", W + "noBreakHyphen": "-"}


def _word_piece(e: ET.Element) -> str | None:
    if e.tag == W + "t":
        return e.text or ""
    if e.tag == W + "br":
        return "\n" if e.get(W + "type", "textWrapping") == "textWrapping" else ""
    return _WORD_CHARACTERS.get(e.tag)


def _word_runs(paragraph: ET.Element) -> list[ET.Element]:
    """Runs in reading order, those of links too."""
    out = []
    for e in paragraph:
        out += [e] if e.tag == W + "r" else [r for r in e if r.tag == W + "r"] if e.tag == W + "hyperlink" else []
    return out


def _word_text(run: ET.Element) -> str:
    return "".join(p for e in run if (p := _word_piece(e)) is not None)


def _set_word_text(run: ET.Element, text: str) -> None:
    for e in [e for e in run if _word_piece(e) is not None]:
        run.remove(e)
    for piece in re.findall(r"\t|\n|[^\t\n]+", text):
        e = ET.SubElement(run, W + {"\t": "tab", "\n": "br"}.get(piece, "t"))
        if piece not in "\t\n":
            e.text = piece
            e.set(SPACE, "preserve")


def _word_paragraphs(container: ET.Element, prefix: str) -> Iterator[tuple[str, ET.Element]]:
    """Paragraphs of a container and of its tables, each kind counted for itself."""
    n = {"p": 0, "t": 0}
    for e in container:
        if e.tag == W + "p":
            yield f"{prefix}:p:{n['p']}", e
            n["p"] += 1
        elif e.tag == W + "tbl":
            for r, row in enumerate(e.findall(W + "tr")):
                for c, cell in enumerate(row.findall(W + "tc")):
                    yield from _word_paragraphs(cell, f"{prefix}:t:{n['t']}:r:{r}:c:{c}")
            n["t"] += 1


#: Containers of a section in order, as (name, reference element, type).
_SECTION = (
    ("header", "headerReference", "default"), ("first-header", "headerReference", "first"), ("even-header", "headerReference", "even"),
    ("footer", "footerReference", "default"), ("first-footer", "footerReference", "first"), ("even-footer", "footerReference", "even"),
)


def _word_blocks(package: Package) -> Iterator[tuple[str, str, ET.Element]]:
    """(part, block id, paragraph): the body first, then each header and footer part once."""
    main = package.main()
    body = package.part(main).find(W + "body")
    if body is None:
        raise BadDocument("no body")
    for block, p in _word_paragraphs(body, "doc"):
        yield main, block, p
    relations = package.relations(main)
    seen: set[str] = set()
    inherited: dict[str, str] = {}
    for s, section in enumerate(body.iter(W + "sectPr")):
        for name, reference, kind in _SECTION:
            own = next((e.get(R + "id") for e in section.findall(W + reference) if e.get(W + "type", "default") == kind), None)
            part = relations[own][1] if own in relations else inherited.get(name)
            if part is None:
                continue
            inherited[name] = part
            if part not in seen:
                seen.add(part)
                for block, p in _word_paragraphs(package.part(part), f"section:{s}:{name}"):
                    yield part, block, p


def read_docx(data: bytes) -> list[tuple[str, str]]:
    texts = ((block, "".join(map(_word_text, _word_runs(p)))) for _, block, p in _word_blocks(Package(data)))
    return [(block, text) for block, text in texts if text.strip()]


def rewrite_docx(data: bytes, rewrite: Rewrite) -> bytes:
    package = Package(data)
    for part, block, p in _word_blocks(package):
        runs = _word_runs(p)
        lengths = [len(_word_text(r)) for r in runs]
        masked = rewrite(block, "".join(map(_word_text, runs)))
        if masked is None:
            continue
        at = 0
        for run, n in zip(runs, lengths):
            _set_word_text(run, masked[at : at + n])
            at += n
        package.changed.add(part)
    return package.saved()


# PowerPoint

_SHAPES = tuple(P + x for x in ("sp", "grpSp", "graphicFrame", "cxnSp", "pic", "contentPart"))


def _frames(tree: ET.Element, prefix: str) -> Iterator[tuple[str, ET.Element]]:
    """Text bodies below a shape tree: of shapes, of groups' shapes, of tables' cells."""
    for i, shape in enumerate(e for e in tree if e.tag in _SHAPES):
        here = f"{prefix}:shape:{i}"
        if shape.tag == P + "grpSp":
            yield from _frames(shape, here)
        elif shape.tag == P + "sp" and (body := shape.find(P + "txBody")) is not None:
            yield f"{here}:text", body
        for r, row in enumerate(shape.findall(f"{A}graphic/{A}graphicData/{A}tbl/{A}tr")):
            for c, cell in enumerate(row.findall(A + "tc")):
                if (body := cell.find(A + "txBody")) is not None:
                    yield f"{here}:r:{r}:c:{c}", body


def _slide_frames(package: Package) -> Iterator[tuple[str, str, ET.Element]]:
    main = package.main()
    relations = package.relations(main)
    for s, e in enumerate(package.part(main).iter(P + "sldId")):
        slide = relations[e.get(R + "id")][1]
        parts = [(slide, f"slide:{s}")] + [(n, f"slide:{s}:notes") for kind, n in package.relations(slide).values() if kind == "notesSlide"]
        for part, prefix in parts:
            tree = package.part(part).find(f"{P}cSld/{P}spTree")
            for block, body in _frames(tree, prefix) if tree is not None else ():
                yield part, block, body


def _pieces(body: ET.Element) -> list[tuple[ET.Element | None, str]]:
    """(text element or None, text) of a text body in order; paragraphs are parted by line feeds."""
    out: list[tuple[ET.Element | None, str]] = []
    for i, p in enumerate(body.findall(A + "p")):
        if i:
            out.append((None, "\n"))
        for e in p:
            if e.tag in (A + "r", A + "fld"):
                t = e.find(A + "t")
                if t is not None:
                    out.append((t, t.text or ""))
            elif e.tag == A + "br":
                out.append((None, "\v"))
    return out


def read_pptx(data: bytes) -> list[tuple[str, str]]:
    texts = ((block, "".join(t for _, t in _pieces(body))) for _, block, body in _slide_frames(Package(data)))
    return [(block, text) for block, text in texts if text.strip()]


def rewrite_pptx(data: bytes, rewrite: Rewrite) -> bytes:
    package = Package(data)
    for part, block, body in _slide_frames(package):
        pieces = _pieces(body)
        masked = rewrite(block, "".join(t for _, t in pieces))
        if masked is None:
            continue
        at = 0
        for e, t in pieces:
            if e is not None:
                e.text = masked[at : at + len(t)]
            at += len(t)
        package.changed.add(part)
    return package.saved()
