"""A strict source of JSON documents.

Documents are files, or lines of files, that Spark lists and reads from any store. A scanner finds the extent of each member without decoding it; then only what may be looked at is decoded. Every repeated key, unknown
or missing field, number that isn't finite and broken document is a row of its own, with its path; nothing stops at the first. Of a sealed record (role BLIND, say) only the
fields that identify it are decoded: its payload is passed over as text, whatever it holds.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import canonical

_BLANK, _STRING, _SCALAR = re.compile(r"[ \t\n\r]*"), re.compile(r'"(?:[^"\\\x00-\x1f]|\\.)*"'), re.compile(r'[^\s,\]\}\{\["]+')
_NESTING = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]')
SCHEMA = "source string, document long, kind string, path string, fault string, identity string, record string, decoded long, skipped long, sound boolean"


class Malformed(ValueError):
    pass


def _skip(text: str, at: int) -> int:
    return _BLANK.match(text, at).end()


def extent(text: str, at: int) -> int:
    """Where the value that begins at `at` ends; strings and brackets are told apart, nothing is decoded."""
    if at >= len(text):
        raise Malformed
    if text[at] == '"':
        found = _STRING.match(text, at)
    elif text[at] in "{[":
        depth = 0
        for token in _NESTING.finditer(text, at):
            c = text[token.start()]
            depth += (c in "{[") - (c in "]}")
            if not depth:
                return token.end()
        raise Malformed
    else:
        found = _SCALAR.match(text, at)
    if found is None:
        raise Malformed
    return found.end()


def _parts(text: str, at: int, keyed: bool) -> Iterator[tuple[str | None, int, int]]:
    """(key, start, end) of the members of an object, or of the elements of an array with no key."""
    close = "}" if keyed else "]"
    at = _skip(text, at + 1)
    if text[at : at + 1] == close:
        return
    while True:
        key = None
        if keyed:
            found = _STRING.match(text, at)
            if found is None:
                raise Malformed
            key, at = json.loads(found[0]), _skip(text, found.end())
            if text[at : at + 1] != ":":
                raise Malformed
            at = _skip(text, at + 1)
        end = extent(text, at)
        yield key, at, end
        at = _skip(text, end)
        if text[at : at + 1] == close:
            return
        if text[at : at + 1] != ",":
            raise Malformed
        at = _skip(text, at + 1)


@dataclass
class Reading:
    """What is found in one document. fields: allowed names by path ([] for any element), each with whether it must be there."""

    text: str
    fields: Mapping[str, Mapping[str, bool]]
    faults: list[tuple[str, str]] = field(default_factory=list)
    decoded: int = 0

    def fault(self, name: str, path: str) -> None:
        self.faults.append((name, path))

    def members(self, at: int, path: str, general: str) -> dict[str, tuple[int, int]]:
        """Extents of an object's members, the last of a repeated key."""
        found: dict[str, tuple[int, int]] = {}
        allowed = self.fields.get(general)
        for key, start, end in _parts(self.text, at, True):
            if key in found:
                self.fault("REPEATED_KEY", f"{path}.{key}".lstrip("."))
            elif allowed is not None and key not in allowed:
                self.fault("UNKNOWN_FIELD", f"{path}.{key}".lstrip("."))
            found[key] = start, end
        for key, needed in (allowed or {}).items():
            if needed and key not in found:
                self.fault("MISSING_FIELD", f"{path}.{key}".lstrip("."))
        return found

    def value(self, start: int, end: int, path: str, general: str):
        first = self.text[start]
        if first == "{":
            return {k: self.value(*at, f"{path}.{k}".lstrip("."), f"{general}.{k}".lstrip(".")) for k, at in self.members(start, path, general).items()}
        if first == "[":
            return [self.value(s, e, f"{path}[{i}]", f"{general}[]") for i, (_, s, e) in enumerate(_parts(self.text, start, False))]
        self.decoded += 1
        try:
            value = json.loads(self.text[start:end])
        except json.JSONDecodeError:
            raise Malformed from None
        if isinstance(value, float) and not math.isfinite(value):
            self.fault("NON_FINITE", path)
            return None
        return value


def read_document(text: str, fields: Mapping[str, Mapping[str, bool]], records: str, identity: str, seal: str, sealed: Sequence[str]) -> tuple[list[tuple[str, str]], list[dict]]:
    """(faults, records) of one document; a record is {position, identity, record (canonical JSON; null if sealed or faulty), decoded, skipped}."""
    reading, made = Reading(text.removeprefix("﻿"), fields), []
    text = reading.text
    try:
        at = _skip(text, 0)
        if text[at : at + 1] != "{" or _skip(text, extent(text, at)) != len(text):
            raise Malformed
        top = reading.members(at, "", "")
        for key, (start, end) in top.items():
            if key != records:
                reading.value(start, end, key, key)
        if records in top:
            start, _ = top[records]
            if text[start] != "[":
                raise Malformed
            for i, (_, start, end) in enumerate(_parts(text, start, False)):
                path, before, known = f"{records}[{i}]", reading.decoded, len(reading.faults)
                if text[start] != "{":
                    reading.fault("NOT_A_RECORD", path)
                    continue
                parts = list(_parts(text, start, True))
                marks = [reading.value(s, e, f"{path}.{k}", "") for k, s, e in parts if k == seal]
                if any(m in sealed for m in marks if isinstance(m, str)):
                    ids = [reading.value(s, e, f"{path}.{k}", "") for k, s, e in parts if k == identity]
                    if len(marks) > 1:
                        reading.fault("REPEATED_KEY", f"{path}.{seal}")
                    skipped = sum(e - s for k, s, e in parts if k not in (seal, identity))
                    made.append({"position": i, "identity": ids[-1] if ids else None, "record": None, "decoded": reading.decoded - before, "skipped": skipped})
                else:
                    reading.decoded = before
                    del reading.faults[known:]
                    value = reading.value(start, end, path, f"{records}[]")
                    sound = len(reading.faults) == known
                    made.append({"position": i, "identity": value.get(identity), "record": canonical(value) if sound else None, "decoded": reading.decoded - before, "skipped": 0})
    except (Malformed, IndexError):
        return [*reading.faults, ("MALFORMED", "")], []
    return reading.faults, made


def strict_documents(spark: SparkSession, path: str, fields: Mapping[str, Mapping[str, bool]], records: str = "records", identity: str = "case_id", seal: str = "role", sealed: Sequence[str] = ("BLIND",), lines: bool = False) -> DataFrame:
    """(source, document, kind, path, fault, identity, record, decoded, skipped, sound): a row of kind FAULT for each fault and one of kind RECORD for each record.

    lines: each line of a file is a document, else each file. document: its number within what a task read, to tell documents of one file apart. sound: the document has no fault.
    decoded: values that were decoded; skipped: characters of values that weren't. Bytes that aren't UTF-8 make a document malformed.
    """
    if lines:
        raw = spark.read.text(path).filter("trim(value) <> ''").select(F.col("_metadata.file_path").alias("source"), F.encode("value", "utf-8").alias("raw"))
    else:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("source"), F.col("content").alias("raw"))
    raw = raw.withColumn("document", F.monotonically_increasing_id())
    return raw.mapInArrow(_reader(fields, records, identity, seal, tuple(sealed)), SCHEMA)


def _reader(fields, records, identity, seal, sealed) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    names = [part.split()[0] for part in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, raw, document in zip(*(batch.column(i) for i in range(3))):
                try:
                    faults, found = read_document(raw.as_py().decode("utf-8"), fields, records, identity, seal, sealed)
                except UnicodeDecodeError:
                    faults, found = [("MALFORMED", "")], []
                rows = [("FAULT", p, f, None, None, None, None) for f, p in faults] + [("RECORD", f"{records}[{r['position']}]", None, None if r["identity"] is None else str(r["identity"]), r["record"], r["decoded"], r["skipped"]) for r in found]
                if rows:
                    columns = [[source.as_py()] * len(rows), [document.as_py()] * len(rows), *map(list, zip(*rows)), [not faults] * len(rows)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run
