"""PDF files as tables of their objects' nodes.

Each object is a small tree: dictionaries and arrays are inner nodes, names, numbers,
strings and references are leaves. What the tree of pages is, what a page inherits and
what a resource refers to is left to joins over this table. Cross-reference tables
and streams, their chains of earlier versions and object streams are followed here;
a file whose cross-references can't be read is searched for its objects instead.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = "object long, node int, parent int, key string, ord int, kind string, value string, target long"
_FIELDS = [("object", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("key", pa.string()), ("ord", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("target", pa.int64())]
#: The number that stands for a file's trailer.
TRAILER = 0
#: Nodes handed on at a time, levels of arrays and dictionaries within one another.
BATCH, DEEPEST = 20_000, 200
#: Longest text of an object whose value is kept for equal ones, and how many are.
SHORT, KNOWN = 1_000, 10_000
# What the file format says parts and what forms tokens.
_BLANK = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_TOKEN = re.compile(rb"<<|>>|[\[\]]|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|<[0-9A-Fa-f\x00\t\n\x0c\r ]*>|\(|[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_REFERENCE = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj(?![a-z])")
_STRING = re.compile(rb"[()\\]")
_HEX = re.compile(rb"#([0-9A-Fa-f]{2})")


class Broken(ValueError):
    """What a file holds is no PDF."""


class Reader:
    """Values at places of a file's bytes: dict, list, str (a name, with its slash), bytes, numbers, None, or ("ref", number)."""

    def __init__(self, data: bytes):
        self.data = data

    def value(self, at: int, depth: int = 0) -> tuple[object, int]:
        at = _BLANK.match(self.data, at).end()
        m = _TOKEN.match(self.data, at)
        if m is None or depth > DEEPEST:
            raise Broken(f"no value at {at}")
        word, end = m[0], m.end()
        if word == b"<<":
            return self._dictionary(end, depth)
        if word == b"[":
            return self._array(end, depth)
        if word == b"(":
            return self._string(end)
        if word[:1] == b"/":
            return _HEX.sub(lambda x: bytes([int(x[1], 16)]), word).decode("latin-1"), end
        if word[:1] == b"<":
            return bytes.fromhex((digits := b"".join(word[1:-1].replace(b"\0", b"").split()).decode()) + "0" * (len(digits) % 2)), end
        if (r := _REFERENCE.match(self.data, at)) is not None:
            return ("ref", int(r[1])), r.end()
        if word in (b"true", b"false", b"null"):
            return {b"true": True, b"false": False, b"null": None}[word], end
        try:
            return (float(word) if b"." in word else int(word)), end
        except ValueError:
            raise Broken(f"no value at {at}") from None

    def _dictionary(self, at: int, depth: int) -> tuple[dict, int]:
        out = {}
        while True:
            at = _BLANK.match(self.data, at).end()
            if self.data.startswith(b">>", at):
                return out, at + 2
            key, at = self.value(at, depth + 1)
            if not isinstance(key, str):
                raise Broken(f"no name before {at}")
            out[key], at = self.value(at, depth + 1)

    def _array(self, at: int, depth: int) -> tuple[list, int]:
        out = []
        while True:
            at = _BLANK.match(self.data, at).end()
            if self.data.startswith(b"]", at):
                return out, at + 1
            x, at = self.value(at, depth + 1)
            out.append(x)

    def _string(self, at: int) -> tuple[bytes, int]:
        open_, start = 1, at
        while (m := _STRING.search(self.data, at)) is not None:
            at = m.end() + (m[0] == b"\\")
            open_ += (m[0] == b"(") - (m[0] == b")")
            if not open_:
                return self.data[start : at - 1], at
        raise Broken(f"a string from {start} doesn't end")


class File:
    """The objects of one file. ``known``: values of equal texts of objects, which files may share; nothing may change them."""

    def __init__(self, data: bytes, known: dict | None = None):
        self.known = known
        if data.find(b"%PDF-", 0, 1024) < 0:
            raise Broken("not a PDF")
        self.data, self.reader = data, Reader(data)
        self.places: dict[int, tuple[int, int]] = {}  # number: (offset, -1) or (stream's number, index)
        self.trailer: dict = {}
        self.streams: dict[int, tuple[dict, bytes]] = {}
        try:
            self._chain()
            self.object(self.trailer["/Root"][1])
        except (Broken, ValueError, KeyError, IndexError, TypeError, RecursionError, zlib.error):
            self._search()
        if "/Root" not in self.trailer:
            raise Broken("no catalogue")
        if "/Encrypt" in self.trailer:
            raise Broken("encrypted")

    def _chain(self) -> None:
        """Cross-references from the last version back to the first; what a later one says holds."""
        at = self.data.rindex(b"startxref") + 9
        todo, seen = [int(self.reader.value(at)[0])], set()
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            at = _BLANK.match(self.data, at).end()
            found = self._table(at + 4) if self.data.startswith(b"xref", at) else self._stream(at)
            self.trailer = found | self.trailer
            todo += [found[k] for k in ("/XRefStm", "/Prev") if isinstance(found.get(k), int)]

    def _table(self, at: int) -> dict:
        while True:
            at = _BLANK.match(self.data, at).end()
            if self.data.startswith(b"trailer", at):
                return self._as_dict(self.reader.value(at + 7)[0])
            first, at = self.reader.value(at)
            count, at = self.reader.value(at)
            rows = self.data[at : at + 20 * count + 4].split()[: 3 * count]
            if len(rows) < 3 * count:
                raise Broken("a short table")
            at = _BLANK.match(self.data, at).end() + 20 * (count - 1)
            at = self.data.index(rows[-1], at) + 1 if count else at
            for k in range(count):
                if rows[3 * k + 2] == b"n" and int(rows[3 * k]):
                    self.places.setdefault(first + k, (int(rows[3 * k]), -1))
                else:
                    self.places.setdefault(first + k, (0, -2))

    def _stream(self, at: int) -> dict:
        head, body = self._body(at)
        widths, size = head["/W"], head["/Size"]
        index = head.get("/Index") or [0, size]
        at = 0
        number = lambda w: int.from_bytes(body[at : at + w], "big")
        for first, count in zip(index[::2], index[1::2], strict=True):
            for k in range(first, first + count):
                row = []
                for w in widths:
                    row.append(number(w) if w else None)
                    at += w
                kind = 1 if row[0] is None else row[0]
                where = {1: (row[1], -1), 2: (row[1], row[2] or 0)}.get(kind, (0, -2))
                self.places.setdefault(k, where)
        return head

    def _search(self) -> None:
        """All objects by what they begin with: of equal numbers the last counts."""
        self.places, self.trailer, self.streams = {}, {}, {}
        for m in _OBJECT.finditer(self.data):
            self.places[int(m[1])] = (m.start(), -1)
        for m in re.finditer(rb"trailer", self.data):
            try:
                self.trailer |= self._as_dict(self.reader.value(m.end())[0])
            except Broken:
                continue
        for n in list(self.places):
            try:
                value = self.object(n)
                kind = value.get("/Type") if isinstance(value, dict) else None
                if kind == "/ObjStm":
                    for k, inner in enumerate(self._inner(n)[0]):
                        self.places.setdefault(inner, (n, k))
                elif kind == "/XRef":
                    self.trailer = value | self.trailer
            except (Broken, ValueError, KeyError, TypeError, RecursionError, zlib.error):
                continue
        if "/Root" not in self.trailer:
            for n in sorted(self.places):
                try:
                    if isinstance(value := self.object(n), dict) and value.get("/Type") == "/Catalog":
                        self.trailer["/Root"] = ("ref", n)
                except (Broken, ValueError, KeyError, TypeError, RecursionError, zlib.error):
                    continue

    @staticmethod
    def _as_dict(x) -> dict:
        if not isinstance(x, dict):
            raise Broken("no dictionary")
        return x

    def _body(self, at: int) -> tuple[dict, bytes]:
        """The dictionary and the unpacked bytes of the stream object at a place."""
        m = _OBJECT.match(self.data, _BLANK.match(self.data, at).end())
        if m is None:
            raise Broken(f"no object at {at}")
        head, at = self.reader.value(m.end())
        at = _BLANK.match(self.data, at).end()
        if not isinstance(head, dict) or not self.data.startswith(b"stream", at):
            raise Broken(f"no stream at {at}")
        at += 6 + (2 if self.data.startswith(b"\r\n", at + 6) else 1)
        size = head.get("/Length")
        if isinstance(size, tuple):
            size = self.object(size[1])
        if not isinstance(size, int) or not self.data[at + size : at + size + 20].lstrip(b"\r\n ").startswith(b"endstream"):
            size = self.data.index(b"endstream", at) - at
        return head, unpacked(self.data[at : at + size], head)

    def _inner(self, n: int) -> tuple[list[int], list[int], Reader]:
        """Numbers and offsets of a stream's objects, and their reader."""
        if n not in self.streams:
            head, body = self._body(self.places[n][0])
            words = list(map(int, body[: head["/First"]].split()))[: 2 * head["/N"]]
            self.streams[n] = (words[::2], [head["/First"] + x for x in words[1::2]], Reader(body))
        return self.streams[n]

    def object(self, n: int):
        at, index = self.places.get(n, (0, -2))
        if index == -2:
            return None
        if index >= 0:
            _, offsets, reader = self._inner(at)
            return reader.value(offsets[index])[0]
        m = _OBJECT.match(self.data, _BLANK.match(self.data, at).end())
        if m is None or int(m[1]) != n:
            raise Broken(f"object {n} isn't at {at}")
        return self.reader.value(m.end())[0] if self.known is None else self._known(m.end())

    def _known(self, at: int):
        """The value at a place, looked up by the text to the object's end where that is short and the value complete in it."""
        end = self.data.find(b"endobj", at, at + SHORT)
        if end <= at or self.data[end - 1] not in b"\n\r \t":
            return self.reader.value(at)[0]
        text = self.data[at:end]
        if text not in self.known:
            try:
                value = Reader(text).value(0)[0]
            except Broken:
                return self.reader.value(at)[0]
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[text] = value
        return self.known[text]


def unpacked(body: bytes, head: dict) -> bytes:
    """A stream's bytes without its filter; only the filter that cross-references use."""
    filters, parms = head.get("/Filter"), head.get("/DecodeParms")
    filters = filters if isinstance(filters, list) else [filters] if filters else []
    parms = parms if isinstance(parms, list) else [parms] * len(filters)
    for name, p in zip(filters, parms, strict=True):
        if name != "/FlateDecode":
            raise Broken(f"filter {name}")
        body = zlib.decompressobj().decompress(body)
        if isinstance(p, dict) and p.get("/Predictor", 1) >= 10:
            body = unpredicted(body, p.get("/Columns", 1) * p.get("/Colors", 1) * p.get("/BitsPerComponent", 8) // 8, max(1, p.get("/Colors", 1) * p.get("/BitsPerComponent", 8) // 8))
    return body


def unpredicted(body: bytes, width: int, step: int) -> bytes:
    """Rows of bytes from their differences, each row after the number of its rule."""
    out, above = bytearray(), bytearray(width)
    for at in range(0, len(body), width + 1):
        rule, row = body[at], bytearray(body[at + 1 : at + 1 + width])
        for i in range(len(row)):
            left, up, corner = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            if rule == 4:
                near = left + up - corner
                guess = min((left, up, corner), key=lambda x: abs(near - x))  # noqa: B023
            else:
                guess = (0, left, up, (left + up) // 2)[rule]
            row[i] = (row[i] + guess) & 255
        out += row
        above = row.ljust(width, b"\0")
    return bytes(out)


def flattened(number: int, value):
    """Node rows of a value, parents before children."""
    rows, todo = [], [(value, None, None, None)]
    while todo:
        x, parent, key, place = todo.pop()
        node = len(rows)
        kind, text, target = "null", None, None
        if isinstance(x, dict):
            kind = "dict"
            todo += [(v, node, k, i) for i, (k, v) in reversed(list(enumerate(x.items())))]
        elif isinstance(x, list):
            kind = "array"
            todo += [(v, node, None, i) for i, v in reversed(list(enumerate(x)))]
        elif isinstance(x, tuple):
            kind, target = "ref", x[1]
        elif isinstance(x, bool):
            kind, text = "bool", str(x).lower()
        elif isinstance(x, str):
            kind, text = "name", x
        elif isinstance(x, bytes):
            kind, text = "string", x.decode("latin-1")
        elif x is not None:
            kind, text = "number", str(x)
        rows.append((number, node, parent, key, place, kind, text, target))
    return rows


def pdf_nodes(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """``keys object node parent key ord kind value target error``: a row for each node of each object.

    ``content`` holds a file's bytes, as the ``binaryFile`` source reads them. A
    trailer is object ``TRAILER``. ``ord``: place among its parent's children. ``target``: the
    object that a reference names. A file or an object that can't be read is a row with an error
    and no node; a null file counts as one that can't be read. One file is in memory at a time.
    """
    fields = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)

    def read(raw: bytes | None):
        try:
            f = File(raw or b"")
        except (Broken, ValueError, KeyError, TypeError, RecursionError, zlib.error) as e:
            yield [], None, str(e) or type(e).__name__
            return
        yield flattened(TRAILER, f.trailer), TRAILER, None
        for n in sorted(f.places):
            try:
                if f.places[n][1] != -2:
                    yield flattened(n, f.object(n)), n, None
            except (Broken, ValueError, KeyError, IndexError, TypeError, RecursionError, zlib.error) as e:
                yield [], n, str(e) or type(e).__name__

    def made(row: pa.RecordBatch, nodes: list, errors: list) -> pa.RecordBatch:
        rows = nodes + [(n, *[None] * 7) for n, _ in errors]
        at = pa.array([0] * len(rows), pa.int32())
        columns = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FIELDS)]
        told = pa.array([None] * len(nodes) + [e for _, e in errors], pa.string())
        return pa.RecordBatch.from_arrays([*(row.column(j).take(at) for j in range(len(keys))), *columns, told], names=[*keys, *(n for n, _ in _FIELDS), "error"])

    def task(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row, nodes, errors = batch.slice(i, 1), [], []
                for rows, number, error in read(row.column(len(keys))[0].as_py()):
                    nodes += rows
                    if error is not None:
                        errors.append((number, error))
                    if len(nodes) >= BATCH:
                        yield made(row, nodes, errors)
                        nodes, errors = [], []
                if nodes or errors:
                    yield made(row, nodes, errors)

    return files.select(*keys, F.col(content)).mapInArrow(task, f"{fields}, {NODE}, error string")
