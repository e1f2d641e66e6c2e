"""Parsing notes: front matter, blocks and chunks.

The grammar is a scan with state, so it runs in Python on Arrow batches; everything before and
after it is columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_pattern
from ..schemas import CHUNK_BARE, CHUNK_FILE, CHUNK_LEAST, CHUNK_MOST, META, MIN_SOLID, PIECE

#: Fixed patterns of the block grammar.
FENCE = re.compile(r"^(\s*)(`{3,}|~{3,})(.*)$")
ATX = re.compile(r"^(\s{0,3})(#{1,6})\s+(.+?)\s*#*\s*$")
SETEXT = re.compile(r"^(\s{0,3})(=+|-+)\s*$")
TABLE_RULE = re.compile(r"^\s*\|?\s*[-:]+[-|\s:]*$")
HASHES = re.compile(r"^(\s*)#{1,6}\s")
QUOTE, BULLET, ORDERED = re.compile(r"^\s*>"), re.compile(r"^\s*[-*+]\s+"), re.compile(r"^\s*\d+\.\s+")
PAIR, ITEM = re.compile(r"^([a-zA-Z0-9_-]+):\s*(.*)$"), re.compile(r"^(\s+)-\s+(.+)$")
NUMBER = re.compile(r"^-?\d+(\.\d+)?$")


def split_frontmatter(raw: str) -> tuple[str, str]:
    """(front matter, body without blank lines before it); all body if the front matter does not end."""
    end = raw.find("\n---", 3) if raw.startswith("---") else -1
    if end < 0:
        return "", raw
    return raw[3:end].strip(), re.sub(r"^\s*\n", "", raw[end + 4 :])


def scalar(raw: str):
    """A value of front matter: list, string, boolean or number."""
    t = raw.strip()
    if t.startswith("[") and t.endswith("]"):
        items = [scalar(x) for x in t[1:-1].split(",")] if t[1:-1].strip() else []
        return [x for x in (" ".join(i) if isinstance(i, list) else text_of(i).strip() for i in items) if x]
    if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'":
        return t[1:-1].strip()
    if t.lower() in ("true", "false"):
        return t.lower() == "true"
    if NUMBER.match(t):
        x = float(t)
        return int(x) if x.is_integer() else x
    return t


def text_of(v) -> str:
    return ("true" if v else "false") if isinstance(v, bool) else str(v)


def parse_frontmatter(source: str | None) -> dict:
    """Typed metadata; what has no place of its own goes to custom, as JSON."""
    meta = {"title": None, "aliases": [], "tags": [], "project": None, "type": None, "status": None, "canonical": None, "canonical_ref": None, "created": None, "updated": None, "custom": {}}

    def put(key: str, v) -> None:
        k = re.sub("[-_]", "", key.lower())
        texts = lambda: [text_of(x) for x in v] if isinstance(v, list) else [text_of(v)]
        if k == "title" and isinstance(v, str):
            meta["title"] = v
        elif k in ("alias", "aliases"):
            for x in texts():
                x = re.sub(r"^[\"']|[\"']$", "", x.strip())
                if x and x not in meta["aliases"]:
                    meta["aliases"].append(x)
        elif k in ("tag", "tags"):
            for x in v.split(",") if isinstance(v, str) else texts():
                x = re.sub("^#", "", x.strip()).lower()
                if x and x not in meta["tags"]:
                    meta["tags"].append(x)
        elif k == "project" and isinstance(v, str | int | float) and not isinstance(v, bool):
            meta["project"] = str(v)
        elif k in ("type", "status") and isinstance(v, str):
            meta[k] = v
        elif k == "canonical":
            meta["canonical"] = True if isinstance(v, list) else bool(v)
        elif k == "canonicalref" and isinstance(v, str):
            meta["canonical_ref"] = re.sub(r"^\[\[(.*)\]\]$", r"\1", v).strip()
        elif k in ("created", "updated"):
            meta[k] = ",".join(v) if isinstance(v, list) else text_of(v)
        else:
            meta["custom"][key] = json.dumps(v, ensure_ascii=False)

    key, items = None, None
    for line in (source or "").splitlines():
        if not line.strip() or line.strip().startswith("#"):
            continue
        if items is not None and (m := ITEM.match(line)):
            if not isinstance(v := scalar(m[2]), list):
                items.append(text_of(v))
        elif m := PAIR.match(line):
            if items is not None:
                put(key, items)
                items = None
            if m[2].strip():
                put(m[1], scalar(m[2]))
            else:
                key, items = m[1], []
    if items is not None:
        put(key, items)
    return meta


def extract_title(meta: dict, body: str, file: str) -> str:
    if meta.get("title"):
        return meta["title"]
    m = re.search(r"^#\s+(.+)$", body, re.M)
    return m[1].strip() if m else re.sub(r"(?i)\.(md|markdown)$", "", file.rsplit("/", 1)[-1])


def parse_blocks(body: str) -> list[dict]:
    """Blocks in order: type, level, heading, text, start_line, end_line (from 1, inclusive)."""
    lines = body.replace("\r\n", "\n").split("\n")
    out, i, n = [], 0, len(lines)

    def add(kind: str, end: int, level=None, heading=None) -> None:
        out.append({"type": kind, "level": level, "heading": heading, "text": "\n".join(lines[i:end]), "start_line": i + 1, "end_line": end})

    def plain(s: str) -> bool:
        return bool(s.strip()) and not (s.lstrip().startswith(("#", ">")) or FENCE.match(s) or BULLET.match(s) or ORDERED.match(s))

    while i < n:
        line, nxt = lines[i], lines[i + 1] if i + 1 < n else None
        if m := FENCE.match(line):
            mark, end = m[2], i + 1
            while end < n and not ((c := lines[end].strip()) and set(c) == {mark[0]} and len(c) >= len(mark)):
                end += 1
            end = min(n, end + 1)
            add("code", end)
        elif m := ATX.match(line):
            end = i + 1
            add("atx_heading", end, len(m[2]), m[3].strip())
        elif nxt is not None and plain(line) and (m := SETEXT.match(nxt)):
            end = i + 2
            add("setext_heading", end, 1 if m[2][0] == "=" else 2, line.strip())
        elif not line.strip():
            end = i + 1
        elif line.lstrip().startswith("|") or ("|" in line and nxt is not None and TABLE_RULE.match(nxt)):
            end = i + 1
            while end < n and lines[end].strip() and ("|" in lines[end] or TABLE_RULE.match(lines[end])):
                end += 1
            add("table", end)
        elif QUOTE.match(line):
            end = i + 1
            while end < n and lines[end].strip() and (QUOTE.match(lines[end]) or not (HASHES.match(lines[end]) or FENCE.match(lines[end]) or BULLET.match(lines[end]) or ORDERED.match(lines[end]))):
                end += 1
            add("blockquote", end)
        else:
            end = i + 1
            while end < n and (s := lines[end]).strip() and not (((m := HASHES.match(s)) and len(m[1]) <= 3) or FENCE.match(s) or QUOTE.match(s) or s.lstrip().startswith("|") or (end + 1 < n and SETEXT.match(lines[end + 1]))):
                end += 1
            add("paragraph", end)
        i = end
    return out


def chunk_budget(tokens: float | None = None, default: int = CHUNK_BARE) -> int:
    return default if tokens is None else max(CHUNK_LEAST, min(CHUNK_MOST, int(tokens * 4 + 0.5)))


def pack_lines(lines: list[str], most: int, base: int = 0) -> list[list[str]]:
    """Runs of lines whose lengths, with a line end each, stay within most; a run has one line at least."""
    out, size = [], 0
    for s in lines:
        if not out or base + size + len(s) + 1 > most:
            out.append([])
            size = 0
        out[-1].append(s)
        size += len(s) + 1
    return out


def cut_line(line: str, most: int) -> list[str]:
    """A long line in pieces, cut at the last space that fits."""
    out = []
    while len(line) > most:
        at = line.rfind(" ", 0, most + 1)
        at = at if at > 0 else most
        out.append(line[:at].strip())
        line = line[at:].strip()
    return [*out, line] if line else out


def split_block(text: str, most: int, kind: str) -> list[str]:
    """A block too large in pieces; fences and table heads are repeated in each."""
    lines = text.split("\n")
    if len(lines) == 1:
        return cut_line(text, most)
    if kind == "code" and len(lines) > 2 and FENCE.match(lines[0]):
        closed = bool(FENCE.match(lines[-1]))
        last, inner = (lines[-1], lines[1:-1]) if closed else ("```", lines[1:])
        if inner:
            return ["\n".join([lines[0], *run, last]) for run in pack_lines(inner, most, len(lines[0]) + len(last) + 2)]
    if kind == "table" and len(lines) > 2 and TABLE_RULE.match(lines[1]):
        return ["\n".join([*lines[:2], *run]) for run in pack_lines(lines[2:], most, len(lines[0]) + len(lines[1]) + 2)]
    out, held = [], []
    for s in lines:
        if len(s) > most:
            out += ["\n".join(run).strip() for run in pack_lines(held, most)] + cut_line(s, most)
            held = []
        else:
            held.append(s)
    return out + ["\n".join(run).strip() for run in pack_lines(held, most)]


def chunk_blocks(blocks: list[dict], most: int = CHUNK_BARE) -> list[dict]:
    """Chunks under the headings in force: blocks packed up to most characters, too large ones split."""
    out, stack, group = [], [], []

    def emit(text: str, start: int, end: int) -> None:
        path = [h for _, h in stack]
        out.append({"heading": path[-1] if path else "", "heading_path": path, "text": text, "start_line": start, "end_line": end})

    def flush() -> None:
        if group:
            emit("\n\n".join(t for t, _, _ in group).strip(), group[0][1], group[-1][2])
            group.clear()

    for b in blocks:
        if b["type"].endswith("_heading"):
            flush()
            while stack and stack[-1][0] >= (b["level"] or 1):
                stack.pop()
            stack.append((b["level"] or 1, b["heading"] or ""))
            continue
        text = b["text"].strip()
        if len(text) > most:
            flush()
            line = b["start_line"]
            for piece in split_block(text, most, b["type"]):
                size = piece.count("\n") + 1
                emit(piece, line, min(b["end_line"], line + size - 1))
                line += size
        elif text:
            if group and sum(len(t) + 2 for t, _, _ in group) + len(text) > most:
                flush()
            group.append((text, b["start_line"], b["end_line"]))
    flush()
    return [c for c in out if len(re.sub(r"\s", "", c["text"])) >= MIN_SOLID]


def parse_note(file: str, raw: str, most: int = CHUNK_FILE) -> tuple[str, dict, list[dict]]:
    """(title, metadata, chunks with lines of the file and headings that fall back to the title)."""
    raw = raw.replace("\r\n", "\n")
    front, body = split_frontmatter(raw)
    meta = parse_frontmatter(front)
    title = extract_title(meta, body, file)
    shift = front.count("\n") + 3 if front else 0  # blank lines before the body are not counted
    chunks = chunk_blocks(parse_blocks(body), most)
    for c in chunks:
        c["heading"] = c["heading"] or title
        c["heading_path"] = c["heading_path"] or [c["heading"]]
        c["start_line"] += shift
        c["end_line"] += shift
    return title, meta, chunks


def parse_docs(docs: DataFrame, most: int = CHUNK_FILE) -> DataFrame:
    """docs(file, raw, ...) with title, meta and pieces, one row a file."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            notes = [parse_note(f, r or "", most) for f, r in zip(b["file"], b["raw"], strict=True)]
            yield b.assign(title=[n[0] for n in notes], meta=[n[1] for n in notes], pieces=[n[2] for n in notes])

    return docs.mapInPandas(parse, f"{kinds}, title string, meta {META}, pieces array<{PIECE}>")


def chunks_of(parsed: DataFrame) -> DataFrame:
    """A row for each chunk, numbered by file and place in chunk_no."""
    keep = [c for c in parsed.columns if c not in ("raw", "pieces")]
    return parsed.select(*keep, F.posexplode("pieces").alias("chunk_no", "p")).select(*keep, "chunk_no", "p.*")


def numbered(chunks: DataFrame) -> DataFrame:
    """chunks with chunk_id, a number that file and place decide."""
    return chunks.withColumn("chunk_id", F.xxhash64("file", "chunk_no"))


#: What opening a note counts in bytes where files are packed into tasks; Spark's own 4 MB would make a task of every 32 notes.
OPEN_COST = 65_536


@contextmanager
def packed_files(spark: SparkSession) -> Iterator[None]:
    """While it holds, scans pack many small files into a task, and many paths are listed by a few tasks for each core."""
    wanted = {"spark.sql.files.openCostInBytes": str(OPEN_COST), "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * spark.sparkContext.defaultParallelism)}
    was = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in was.items():
            spark.conf.set(name, value)


NOTE_FILE = r"(?i)\.(md|markdown)$"


def scan_notes(spark: SparkSession, path: str, ignore: list[str] | None = None) -> DataFrame:
    """file (relative), raw, md5, mtime of the notes below path.

    Names that start with a dot are passed over, and what an ignore glob meets as a relative
    path, as a name, or as a folder on the way. Spark's own listing also leaves out names that
    start with an underscore.
    """
    root = path.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{[mM][dD],[mM][aA][rR][kK][dD][oO][wW][nN]}").load(root)
    bare = root.split("://", 1)[-1]
    rel = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^.*?" + re.escape(bare.lstrip("/")) + "/", "")
    df = files.select(rel.alias("file"), F.decode("content", "UTF-8").alias("raw"), F.md5("content").alias("md5"), F.col("modificationTime").alias("mtime"))
    df = df.where(F.col("file").rlike(NOTE_FILE) & ~F.col("file").rlike(r"(^|/)\."))
    for g in ignore or []:
        p = glob_pattern(g)
        on_the_way = F.transform(F.sequence(F.lit(1), F.size(F.split("file", "/"))), lambda i: F.array_join(F.slice(F.split(F.col("file"), "/"), F.lit(1), i), "/"))
        names = F.split("file", "/")
        df = df.where(~F.exists(on_the_way, lambda x: x.rlike(p)) & ~F.exists(names, lambda x: x.rlike(p)))  # noqa: B023
    return df


def title_column(front: Column, body: Column, file: Column) -> Column:
    """extract_title() as a column, for tables whose front matter is at hand."""
    first = lambda text, p: F.regexp_extract(text, p, 1)
    named = F.regexp_replace(F.trim(first(front, r"(?m)^title:\s*(.+)$")), r"^[\"']|[\"']$", "")
    return F.coalesce(F.when(named != "", named), F.when(first(body, r"(?m)^#\s+(.+)$") != "", F.trim(first(body, r"(?m)^#\s+(.+)$"))), F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"(?i)\.(md|markdown)$", ""))
