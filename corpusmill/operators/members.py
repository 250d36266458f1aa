"""Members of source files: which class, method or field each piece of a line belongs to.

A file's lines are read once, in order, with a small state: inside a comment, a text block or code; the depth of parentheses; the open braces;
and the pieces of a declaration that has begun but not yet shown its kind. So annotations on lines before, a signature over several
lines and a body are one member, and braces, quotes and annotations in comments or texts count for nothing. The state does not
grow with the file: it holds the open blocks and the lines of one declaration's head. Files are dealt by their path; a repo of any
size is spread over its files. What a short line or head is, is kept by the worker for the next one of the same text, up to ``KNOWN`` of them.

What it is not: a parser. Types are not resolved; a declaration is told by the shape of its head."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StringType, StructType

CODE, COMMENT, BLOCK = 0, 1, 2
TEXT = r'"(?:[^"\\]|\\.)*"'
TOKEN = re.compile(r'"""|"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|//|/\*')
MARKS = re.compile(r"[(){};]")
TYPE = re.compile(r"(?:^|[\s@])(class|interface|enum|record)\s+([A-Za-z_]\w*)")
CALLABLE = re.compile(r"([A-Za-z_]\w*)\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:throws\s[\w\s.,]+)?$")
FIELD = re.compile(r"([A-Za-z_]\w*)\s*(?:\[\s*\]\s*)*(?:=.*)?$", re.S)
ANNOTATION = re.compile(r"@(?!interface\b)[A-Za-z_][\w.]*\s*(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?")
NAMES = ["code", "part", "kind", "name", "owner", "owner_at", "member", "last_line"]
PARTS = ("head", "body", "member")
KNOWN, SHORT = 1 << 14, 200  # texts that a worker keeps of each kind, and the characters of one at most
_lines, _heads = ({}, {}, {}), {}  # by the state before a line


def lexed(text: str, state: int) -> tuple[str, str, int]:
    """A line without its comments, the same with the contents of its texts blanked, and the state behind it."""
    if state == CODE and not TOKEN.search(text):
        return text, text, CODE
    code, bare, i = [], [], 0
    while i < len(text):
        if state == CODE:
            found = TOKEN.search(text, i)
            end = found.start() if found else len(text)
            code.append(text[i:end])
            bare.append(text[i:end])
            if not found or found.group() == "//":
                break
            i = found.end()
            if found.group() == "/*":
                state = COMMENT
                code.append(" ")
                bare.append(" ")
            else:
                state = BLOCK if found.group() == '"""' else CODE
                code.append(found.group())
                bare.append('"' + "_" * (len(found.group()) - 2) + '"')
        else:
            end = text.find("*/" if state == COMMENT else '"""', i)
            if state == BLOCK:
                piece = text[i:] if end < 0 else text[i : end + 3]
                code.append(piece)
                bare.append("_" * len(piece))
            if end < 0:
                break
            i, state = end + (2 if state == COMMENT else 3), CODE
    return "".join(code), "".join(bare), state


def keep(known: dict, text: str, found):
    if len(text) <= SHORT:
        if len(known) >= KNOWN:
            known.clear()
        known[text] = found
    return found


def marked(text: str, state: int) -> tuple:
    """What lexed() gives, the marks with their ends, and whether any code is there."""
    found = _lines[state].get(text)
    if found is None:
        code, bare, after = lexed(text, state)
        found = keep(_lines[state], text, (code, bare, after, [(m.group(), m.end()) for m in MARKS.finditer(bare)], bool(code) and not code.isspace()))
    return found


def declared(head: str) -> tuple[str, str | None]:
    """Kind and name of a head."""
    found = _heads.get(head)
    return keep(_heads, head, _declared(head)) if found is None else found


def _declared(head):
    plain = ANNOTATION.sub(" ", head).strip()
    found = TYPE.search(plain)
    if found and ("(" not in plain[: found.start()]):
        return "class", found.group(2)
    before = plain.split("=", 1)[0].rstrip() if "=" in plain else plain
    found = CALLABLE.search(before)
    if found and "=" not in plain:
        return "method", found.group(1)
    if not plain or re.match(r"(package|import)\b", plain):
        return "file", plain
    if plain == "static":
        return "method", "static"
    found = FIELD.search(plain)
    return ("field", found.group(1)) if found else ("file", plain)


class Scan:
    """The state of one file. line() takes its lines in order and gives (line, *NAMES) of each piece that is settled, of the parts asked for."""

    def __init__(self, parts=PARTS):
        self.state, self.round, self.members = CODE, 0, 0
        self.classes = []  # (name, member) of open classes
        self.inside, self.nested = None, 0  # the open member that is no class, as a row of part member, and the open blocks in it
        self.head, self.begun = [], []  # bare pieces of a head, and its pieces: (line, code)
        self.heads, self.bodies, self.whole = ("head" in parts, "body" in parts, "member" in parts)

    def _settle(self, kind, name, opens=False):
        """What the head that has begun gives; the member stays open if a block begins, and is whole otherwise."""
        self.members += 1
        owner, at = self.classes[-1] if self.classes else (None, None)
        pieces = [(line, code) for line, code in self.begun if code.strip(" \t\r;")]
        out = [(line, code, "head", kind, name, owner, at, self.members, None) for line, code in pieces] if self.heads else []
        row = None
        if pieces and kind != "file":
            row = [pieces[0][0], " ".join(code for _, code in pieces), "member", kind, name, owner, at, self.members, pieces[-1][0]]
        self.head, self.begun = [], []
        if opens and kind != "class":
            self.inside, self.nested = row, 0
        elif row and self.whole:
            out.append(tuple(row))
        return out

    def _body(self, line, code):
        """A piece of the open member's body."""
        m = self.inside
        m[8] = line
        return [(line, code, "body", m[3], m[4], m[5], m[6], m[7], None)] if self.bodies else []

    def _closed(self):
        row, self.inside = self.inside, None
        return [tuple(row)] if self.whole else []

    def line(self, number: int, text: str):
        code, bare, self.state, marks, any_code = marked(text, self.state)
        if not marks:
            if any_code:
                if self.inside is not None:
                    return self._body(number, code)
                self.head.append(bare)
                self.begun.append((number, code))
            return ()
        out, start, open_ = [], 0, self.round
        for c, end in marks:
            if c == "(":
                open_ += 1
                continue
            if c == ")":
                open_ -= open_ > 0
                continue
            if open_:  # of an annotation's list, or of a call's argument
                if self.inside is None or c == ";":
                    continue
            if self.inside is not None:
                if c == "{":
                    self.nested += 1
                elif c == "}":
                    self.nested -= 1
                    if self.nested < 0:
                        out += self._body(number, code[start:end])
                        out += self._closed()
                        start, open_ = end, 0
                continue
            self.head.append(bare[start:end].rstrip("{};"))
            self.begun.append((number, code[start:end]))
            start = end
            if c == "{":
                kind, name = declared(" ".join(self.head))
                kind = "method" if kind == "file" else kind
                out += self._settle(kind, name, opens=True)
                if kind == "class":
                    self.classes.append((name, self.members))
            elif c == ";":
                kind, name = declared(" ".join(self.head))
                out += self._settle(kind, name)
            else:
                out += self._settle("field", None) if any(x.strip(" }\t") for _, x in self.begun) else []
                self.head, self.begun = [], []
                if self.classes:
                    self.classes.pop()
        self.round = open_
        rest = code[start:] if start else code
        if rest and not rest.isspace():
            if self.inside is not None:
                out += self._body(number, rest)
            else:
                self.head.append(bare[start:])
                self.begun.append((number, rest))
        return out

    def end(self):
        out = self._settle("file", None) if self.begun else []
        return out + (self._closed() if self.inside is not None else [])


def runs(*columns: pa.Array) -> np.ndarray:
    """Where the stretches of rows begin that have the same values."""
    edge = np.zeros(len(columns[0]), bool)
    edge[:1] = True
    for c in columns:
        one, other = c[1:], c[:-1]
        differ = pc.fill_null(pc.not_equal(one, other), True)  # unless both are null
        edge[1:] |= pc.and_not(differ, pc.and_(pc.is_null(one), pc.is_null(other))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(edge)


def values(column: pa.Array) -> list:
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def scoped_lines(lines: DataFrame, parts: tuple = PARTS) -> DataFrame:
    """The pieces of code of lines (repo, path, line, text): code, part (head or body), kind (class, method, field, file), name, owner (the class
    around it) and owner_at (that class's member), member (its number in the file; a class's head is a member of its own). Of part member there is
    one row a member, when it ends: line and last_line where it begins and ends, code its head. Only the parts asked for are given."""
    kinds = {f.name: f for f in lines.schema}
    schema = StructType([kinds[c] for c in ("repo", "path", "line")])
    for name in NAMES:
        schema.add(name, kinds["line"].dataType if name == "last_line" else IntegerType() if name in ("owner_at", "member") else StringType())

    def scan(batches):
        rows, arrow = [], [*[kinds[c].dataType for c in ("repo", "path", "line")], *[f.dataType for f in schema.fields[3:]]]
        arrow = [to_arrow_type(t) for t in arrow]

        def batch():
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), arrow)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, ["repo", "path", "line", *NAMES])

        for place, pieces in scanned(batches, parts):
            rows.extend([place + p for p in pieces])
            if len(rows) >= 4096:
                yield batch()
        if rows:
            yield batch()

    return by_file(lines).mapInArrow(scan, schema)


def by_file(lines: DataFrame) -> DataFrame:
    """repo, path, line, text, dealt by file and in order."""
    return lines.select("repo", "path", "line", "text").repartition("repo", "path").sortWithinPartitions("repo", "path", "line")


def scanned(batches, parts: tuple):
    """(repo, path) and the pieces that Scan gives, from batches of by_file()."""
    place, state = None, None
    for b in batches:
        numbers, texts = values(b.column(2)), values(pc.fill_null(b.column(3), ""))
        starts = runs(b.column(0), b.column(1))
        places = zip(*(values(b.column(c).take(pa.array(starts))) for c in (0, 1)))
        for here, i, j in zip(places, starts.tolist(), [*starts[1:].tolist(), len(texts)]):
            if place != here:
                if place is not None:
                    yield place, state.end()
                place, state = here, Scan(parts)
            for line, text in zip(numbers[i:j], texts[i:j]):
                found = state.line(line, text)
                if found:
                    yield place, found
    if place is not None:
        yield place, state.end()


def members(pieces: DataFrame) -> DataFrame:
    """One row a member of scoped_lines(): kind, name, owner, first and last line, annotations (by name, in order), and its head in one line."""
    out = pieces.where("part = 'member'").select("repo", "path", "member", "kind", "name", "owner", "owner_at", F.col("line").alias("first_line"), "last_line", "code", head_text("code").alias("head"))
    # of the head as it stands, so that its one line is made only where it is asked for
    out = out.withColumn("annotations", F.regexp_extract_all(F.regexp_replace("code", f"(?s){TEXT}", "''"), F.lit(r"@(?!interface\b)([A-Za-z_][\w.]*)"), F.lit(1)))
    return out.drop("code")


def head_text(code: str) -> Column:
    """A head in one line, without the mark that ends it."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(code, r"\s+", " ")), r"[{;]\s*$", ""))
