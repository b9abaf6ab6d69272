"""Semi-structured text as node tables, and format detection.

JSON, NDJSON, YAML, CSV, Markdown and other texts become JSON values; values become nodes. The walk over a
text runs in Arrow batches, keeps each number's own spelling and the last of repeated keys, and refuses
nesting deeper than MAX_DEPTH.
"""

from __future__ import annotations

import csv
import gzip
import io
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DEPTH = 256
EXTENSIONS = {"json": "json", "ndjson": "ndjson", "jsonl": "ndjson", "yaml": "yaml", "yml": "yaml", "csv": "csv", "tsv": "tsv", "md": "markdown", "markdown": "markdown", "cpuprofile": "cpuprofile", "strace": "strace"}


class ParseError(ValueError):
    """A text that is not of its format."""


class Real(float):
    """A float that remembers its spelling."""

    __slots__ = ("text",)

    def __new__(cls, text: str) -> Real:
        out = super().__new__(cls, text)
        out.text = text
        return out


def parse_json(text: str) -> object:
    return json.loads(text, parse_float=Real)


def type_of(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer" if -(1 << 63) <= value < (1 << 64) else "float"
    if isinstance(value, float):
        return "float"
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def canonical(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    return value.text if isinstance(value, Real) else str(value)


def walk(value: object, root: str = "$") -> Iterator[tuple[str, int, str, str | None, float | None]]:
    """(path, depth, type, value, num) of a value and all below it, parents first, keys in order."""
    stack = [(value, root, root.count("[*]") + root.count("."))]
    while stack:
        v, path, depth = stack.pop()
        if depth > MAX_DEPTH:
            raise ParseError(f"nested deeper than {MAX_DEPTH}")
        kind = type_of(v)
        if kind == "object":
            yield path, depth, kind, None, None
            stack.extend((v[k], f"{path}.{k}", depth + 1) for k in sorted(v, reverse=True))
        elif kind == "array":
            yield path, depth, kind, None, None
            stack.extend((x, f"{path}[*]", depth + 1) for x in reversed(v))
        else:
            yield path, depth, kind, canonical(v), float(v) if kind in ("integer", "float") else None


def json_nodes(texts: DataFrame, record_id: str, body: str, root: str = "$", on_error: str = "raise") -> DataFrame:
    """Node table of JSON texts. ``on_error``: ``raise``, or ``skip`` texts that do not parse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None or not text.strip():
                    continue
                try:
                    found = list(walk(parse_json(text), root))
                except (ValueError, RecursionError) as error:
                    if on_error == "raise":
                        raise ParseError(f"record {key}: {error}") from None
                    continue
                rows += found
                ids += [key] * len(found)
            path, depth, kind, value, num = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(path, pa.string()), pa.array(depth, pa.int32()), pa.array(kind, pa.string()), pa.array(value, pa.string()), pa.array(num, pa.float64())],
                names=["record_id", "path", "depth", "type", "value", "num"],
            )

    kind = dict(texts.dtypes)[record_id]
    return texts.select(record_id, body).mapInArrow(run, f"record_id {kind}, path string, depth int, type string, value string, num double")


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of an NDJSON file's lines, as the records of one array; blank lines are skipped."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("record_id"), "value")
    return json_nodes(lines, "record_id", "value", root="$[*]")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of whole files (path or folder), each parsed by its format; record_id is the file's path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, bodies = [], []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(name)
                bodies.append(json.dumps(parse_file(name, data), default=str))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.string())], names=["record_id", "body"])

    texts = files.select("path", "content").mapInArrow(run, "record_id string, body string")
    return json_nodes(texts, "record_id", "body")


def decompress(name: str, data: bytes) -> tuple[str, bytes]:
    """(name without the compression's ending, plain bytes): gzip and zstd, by ending or first bytes."""
    if name.endswith(".gz") or data[:2] == b"\x1f\x8b":
        return name.removesuffix(".gz"), gzip.decompress(data)
    if name.endswith((".zst", ".zstd")) or data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return name.removesuffix(".zst").removesuffix(".zstd"), zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read()
    return name, data


def sniff(text: str) -> str:
    """The format that a text looks like; JSON if nothing else."""
    head = text.lstrip("﻿ \t\r\n")
    lines = [x for x in head.split("\n") if x.strip()][:5]
    if "% time" in head[:200]:
        return "strace"
    if head[:1] in ("{", "["):
        return "ndjson" if sum(x.lstrip().startswith("{") for x in lines) >= 2 and head[:1] == "{" else "json"
    if head.startswith("# "):
        return "markdown"
    if head.startswith(("---", "- ")) or re.match(r"[A-Za-z_][\w-]*:(\s|$)", head):
        return "yaml"
    return "json"


def parse_file(name: str, data: bytes) -> object:
    """The JSON value of a file's bytes."""
    plain, data = decompress(name, data)
    text = data.decode("utf-8-sig")
    ending = plain.rsplit(".", 1)[-1].lower() if "." in plain.rsplit("/", 1)[-1] else ""
    return parse_text(text, EXTENSIONS.get(ending) or sniff(text))


def parse_text(text: str, kind: str) -> object:
    if kind == "json":
        return parse_json(text)
    if kind == "ndjson":
        out = []
        for n, line in enumerate(text.split("\n"), 1):
            if line.strip():
                try:
                    out.append(parse_json(line))
                except ValueError as error:
                    raise ParseError(f"line {n}: {error}") from None
        return out
    if kind == "yaml":
        return parse_yaml(text)
    if kind in ("csv", "tsv"):
        return parse_csv(text, "," if kind == "csv" else "\t")
    if kind == "markdown":
        return parse_markdown(text)
    if kind == "strace":
        return parse_strace(text)
    if kind == "cpuprofile":
        return parse_cpuprofile(parse_json(text))
    raise ParseError(f"unknown format {kind}")


def parse_yaml(text: str) -> object:
    """One document, or the list of several; merge keys are resolved, empty documents dropped."""
    try:
        import yaml
    except ImportError:
        raise ParseError("reading YAML needs PyYAML") from None
    docs = [d for d in yaml.safe_load_all(text) if d is not None]
    return docs[0] if len(docs) == 1 else docs


def infer_cell(cell: str) -> object:
    """A CSV cell's value: empty is null, then integer, float, string."""
    if cell == "":
        return None
    if re.fullmatch(r"[+-]?\d+", cell) and -(1 << 63) <= int(cell) < (1 << 63):
        return int(cell)
    try:
        number = Real(cell)
    except ValueError:
        return cell
    return number if number == number and abs(number) != float("inf") and "_" not in cell else cell


def parse_csv(text: str, delimiter: str = ",") -> list[dict[str, object]]:
    """Rows as objects by the header; short rows lack their last fields, further cells are left out."""
    rows = csv.reader(io.StringIO(text), delimiter=delimiter)
    header = next(rows, None)
    if header is None:
        return []
    return [dict(zip(header, map(infer_cell, row), strict=False)) for row in rows if row]


def parse_markdown(text: str) -> dict[str, object]:
    """Tree of sections with paragraphs, lists, code blocks, quotes and tables, and counts of each."""
    root: dict[str, object] = {"type": "markdown", "sections": [], "content": []}
    counts = dict.fromkeys(("heading_count", "paragraph_count", "list_count", "code_block_count", "table_count", "link_count", "quote_count", "word_count"), 0)
    stack: list[tuple[int, dict]] = [(0, root)]
    lines, at = text.split("\n"), 0

    def put(kind: str, body: object) -> None:
        stack[-1][1]["content"].append({"type": kind, "text": body})

    while at < len(lines):
        line = lines[at]
        if m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line):
            level = len(m[1])
            while stack[-1][0] >= level:
                stack.pop()
            section = {"heading": m[2], "level": level, "content": [], "subsections": []}
            stack[-1][1]["subsections" if stack[-1][0] else "sections"].append(section)
            stack.append((level, section))
            counts["heading_count"] += 1
            at += 1
        elif m := re.match(r"(`{3,}|~{3,})", line):
            end = next((k for k in range(at + 1, len(lines)) if lines[k].startswith(m[1])), len(lines))
            put("code", "\n".join(lines[at + 1 : end]))
            counts["code_block_count"] += 1
            at = end + 1
        elif not line.strip():
            at += 1
        else:
            kind, test = next(
                ((k, t) for k, t in (("list", r"\s*([-*+]|\d+[.)])\s+"), ("quote", r"\s*>"), ("table", r"\s*\|")) if re.match(t, line)),
                ("paragraph", None),
            )
            end = at + 1
            while end < len(lines) and lines[end].strip() and (re.match(test, lines[end]) if test else not re.match(r"#{1,6}\s|`{3}|~{3}|\s*([-*+]|\d+[.)])\s+|\s*>|\s*\|", lines[end])):
                end += 1
            put(kind, [re.sub(test, "", x, count=1).strip() for x in lines[at:end]] if kind == "list" else "\n".join(x.strip() for x in lines[at:end]))
            counts[f"{kind}_count"] += 1
            at = end
    counts["link_count"] = len(re.findall(r"\[[^\]]*\]\([^)]+\)", text))
    counts["word_count"] = len(text.split())
    return {"type": "markdown", "metadata": counts, "content": root["content"], "sections": root["sections"]}


def parse_strace(text: str) -> list[dict[str, object]]:
    """Rows of an ``strace -c`` table; the total line is left out, missing errors are 0."""
    out = []
    for line in text.split("\n"):
        parts = line.split()
        if len(parts) in (5, 6) and re.fullmatch(r"[\d.]+", parts[0]) and parts[-1] != "total":
            numbers = parts[:-1]
            out.append({"time_pct": Real(numbers[0]), "seconds": Real(numbers[1]), "usecs_per_call": int(numbers[2]), "calls": int(numbers[3]), "errors": int(numbers[4]) if len(numbers) > 4 else 0, "syscall": parts[-1]})
    return out


def parse_cpuprofile(profile: dict) -> list[dict[str, object]]:
    """Samples by function of a V8 CPU profile: function, file, source (runtime, dependency or app), samples, pct."""
    names = {n["id"]: n.get("callFrame", {}) for n in profile.get("nodes", [])}
    counts: dict[tuple[str, str], int] = {}
    for sample in profile.get("samples", []):
        frame = names.get(sample, {})
        key = (frame.get("functionName") or "(anonymous)", frame.get("url") or "")
        counts[key] = counts.get(key, 0) + 1
    total = sum(counts.values()) or 1

    def source(url: str) -> str:
        return "dependency" if "node_modules" in url else "runtime" if not url or url.startswith("node:") else "app"

    return [{"function": f, "file": u, "source": source(u), "samples": n, "pct": Real(repr(100 * n / total))} for (f, u), n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]


def canonical_json(value: object) -> str:
    """RFC 8785: keys in UTF-16 order, shortest numbers, no spaces."""

    def number(x: float) -> str:
        if x == 0:
            return "0"
        if x == int(x) and abs(x) < 1e21:
            return str(int(x))
        text = repr(float(x))
        if "e" in text:
            head, power = text.split("e")
            p = int(power)
            if -6 <= p < 0:
                digits = head.replace(".", "").replace("-", "")
                return ("-" if x < 0 else "") + "0." + "0" * (-p - 1) + digits
            return f"{head.removesuffix('.0')}e{'+' if p > 0 else ''}{p}"
        return text

    if value is None or isinstance(value, (bool, str)):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (int, float)):
        return number(float(value)) if isinstance(value, float) or abs(value) >= 1 << 53 else str(value)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"


def parse_git_log(text: str) -> list[dict[str, str]]:
    """Commits of ``git log --format=%H%x1f%an%x1f%ae%x1f%aI%x1f%s``."""
    names = ("hash", "author_name", "author_email", "date", "subject")
    return [dict(zip(names, line.split("\x1f"), strict=True)) for line in text.split("\n") if line.count("\x1f") == 4]
