"""Output of test runners as rows of results.

A run is one text, or its lines as a table. A run's lines go in order through a small state machine,
in Arrow batches of lines, so neither its text nor its results are ever one object in Python: what is
held of the run at hand is a packed table of its results, because failures are explained, packages
named and whole runs refused by lines that come later.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "run_id string, format string, runner string, ord bigint, name string, status string, duration_ms bigint, file string, line int, message string, stdout string, stderr string, suite string"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]
#: Of equal scores the earlier wins.
ORDER = ("junit", "libtest_json", "gotest_json", "tap", "libtest", "pytest", "jest", "gotest", "flutter")
RUNNERS = {"junit": "junit", "libtest": "cargo-test", "libtest_json": "cargo-test", "gotest": "go-test", "gotest_json": "go-test", "tap": "tap", "pytest": "pytest", "jest": "jest", "flutter": "flutter-test"}
FORMAT_ALIASES = {"cargo": "libtest", "rust": "libtest", "go": "gotest", "go-json": "gotest_json", "xml": "junit", "py": "pytest"}


def line_scores(line: Column) -> dict[str, Column]:
    t = F.trim(line)
    points = lambda n, c: F.when(c, n).otherwise(0)
    return {
        "junit": points(5, t.rlike("^<testsuites?\\b")) + points(3, t.contains("</testcase>") | t.contains("<testcase ")),
        "libtest_json": points(3, t.rlike(r'^\{.*"type"\s*:\s*"(suite|test)"')),
        "gotest_json": points(3, t.startswith("{") & t.contains('"Action"') & t.contains('"Test"')),
        "tap": points(3, t.rlike("^(not )?ok (?! \t)")) + points(2, t.rlike(r"^1\.\.\d*$")),
        "libtest": points(3, t.rlike("^(test result:|running )")) + points(2, t.rlike(r"^test .*\.\.\. (ok|FAILED|ignored)$")),
        "pytest": points(3, t.contains("::") & t.rlike("PASSED|FAILED|ERROR")) + points(2, t.startswith("=") & t.rlike("passed|failed|error")),
        "jest": points(3, t.startswith("Tests:") & t.rlike("passed|failed")) + points(2, t.rlike("^(PASS|FAIL) ")),
        "gotest": points(3, t.rlike("^--- (FAIL|PASS|SKIP):")) + points(2, t.rlike("^(FAIL|ok  )\t")),
        "flutter": points(1, t.rlike(r"^\d{2}:\d{2} \+\d+( -\d+)?( ~\d+)?: ")),
    }


def detect(runs: DataFrame) -> DataFrame:
    """(run_id, format) of (run_id, content), by all lines."""
    return detect_lines(runs.select("run_id", F.explode(F.split("content", "\n")).alias("line")))


def detect_lines(lines: DataFrame) -> DataFrame:
    """(run_id, format) of (run_id, line), by all lines."""
    scores = lines.groupBy("run_id").agg(*[F.sum(c).alias(k) for k, c in line_scores(F.col("line")).items()])
    best = F.array_max(F.array(*[F.struct(F.col(k).alias("score"), F.lit(-i).alias("i"), F.lit(k).alias("format")) for i, k in enumerate(ORDER)]))
    return scores.select("run_id", F.when(best["score"] > 0, best["format"]).otherwise("unknown").alias("format"))


def _result(name: str, status: str, **more) -> dict:
    return {"name": name, "status": status, **more}


_TYPES = {"ord": pa.int64(), "duration_ms": pa.int64(), "line": pa.int32()}
_SCHEMA = pa.schema([(c, _TYPES.get(c, pa.string())) for c in _NAMES])
_CELLS = _NAMES[4:]
PACK = 2048  # results that are packed together


class Results:
    """The results of one run in order: the last ones as dicts, those before packed, without columns that are null."""

    def __init__(self):
        self.packed: list[pa.RecordBatch] = []
        self.rows: list[dict] = []
        self.changed: dict[int, dict] = {}  # what later lines say of packed results
        self.suites: list[tuple[int, str]] = []  # (end, suite) of ranges of results that a later line gives a suite

    def __len__(self) -> int:
        return len(self.packed) * PACK + len(self.rows)

    def append(self, r: dict) -> int:
        self.rows.append(r)
        n = len(self)
        if len(self.rows) == PACK:
            some = [c for c in _CELLS if any(r.get(c) is not None for r in self.rows)]
            self.packed.append(pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in self.rows], _SCHEMA.field(c).type) for c in some], names=some))
            self.rows = []
        return n - 1

    def get(self, i: int, field: str):
        k, j = divmod(i, PACK)
        if k == len(self.packed):
            return self.rows[j].get(field)
        if field in self.changed.get(i, {}):
            return self.changed[i][field]
        return self.packed[k].column(field)[j].as_py() if field in self.packed[k].schema.names else None

    def change(self, i: int, **values) -> None:
        k, j = divmod(i, PACK)
        (self.rows[j] if k == len(self.packed) else self.changed.setdefault(i, {})).update(values)

    def names(self) -> Iterator[str]:
        for b in self.packed:
            yield from b.column("name").to_pylist()
        yield from (r["name"] for r in self.rows)

    def attach(self, blocks: list[tuple[str, list[str]]], same: Callable[[str, str], bool], message: Callable[[list[str]], str | None], keys: Callable[[str], list[str]] | None = None) -> None:
        """Give the text of each failure's block to the first result that it names. keys: all the results' names that
        could be the same as a block's, where there are only some."""
        texts = ["\n".join(lines).strip() for _, lines in blocks]
        hits: dict[int, int] = {}
        left = {i for i, text in enumerate(texts) if text}
        by_name: dict[str, list[int]] = {}
        for i in left if keys else ():
            for k in keys(blocks[i][0]):
                by_name.setdefault(k, []).append(i)
        if left:
            for at, name in enumerate(self.names()):
                for i in [i for i in (by_name.get(name, ()) if keys else left) if i in left and same(name, blocks[i][0])]:
                    hits[i] = at
                    left.discard(i)
                if not left:
                    break
        for i in sorted(hits):
            self.change(hits[i], stdout=texts[i], message=self.get(hits[i], "message") or message(texts[i].split("\n")))

    def batches(self, run_id: str | None, fmt: str) -> Iterator[pa.RecordBatch]:
        """Everything, as rows of RESULT."""
        start, suites = 0, iter([*self.suites, (len(self), None)])
        end, suite = next(suites)
        for b in [*self.packed, None]:
            rows = {c: [r.get(c) for r in self.rows] for c in _CELLS} if b is None else {c: b.column(c).to_pylist() for c in b.schema.names}
            n = len(self.rows) if b is None else b.num_rows
            if not n:
                continue
            for i in range(start, start + n):
                for c, v in self.changed.get(i, {}).items() if self.changed else ():
                    rows.setdefault(c, [None] * n)[i - start] = v
                while i >= end:
                    end, suite = next(suites)
                if suite is not None:
                    rows.setdefault("suite", [None] * n)[i - start] = suite
            head = {"run_id": [run_id] * n, "format": [fmt] * n, "runner": [RUNNERS.get(fmt, fmt)] * n, "ord": range(start, start + n)}
            rows = head | rows
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], _SCHEMA.field(c).type) if c in rows else pa.nulls(n, _SCHEMA.field(c).type) for c in _NAMES], schema=_SCHEMA)
            start += n


def _ms(text: str | None, unit: str | None = "s") -> int | None:
    return None if text is None else round(float(text) * (1 if unit == "ms" else 1000))


def libtest(lines: Iterable[str], out: Results) -> None:
    blocks, block, suite = [], None, None
    for line in lines:
        if block is not None:
            if not re.match(r"---- |failures:|test result:", line):
                block[1].append(line)
                continue
            block = None
        if m := re.match(r"\s*Running (?:unittests )?.*?\(?\S*deps/([A-Za-z0-9_]+?)(?:-[0-9a-f]{8,})?\)?\s*$", line):
            suite = m[1]
        elif m := re.match(r"\s*Doc-tests (\S+)", line):
            suite = m[1].replace("-", "_")
        elif m := re.match(r"---- (.+?) stdout ----", line):
            block = (m[1], [])
            blocks.append(block)
        elif m := re.match(r"test (.+?) \.\.\. (ok|FAILED|ignored)\b(?:.*?<?(\d+(?:\.\d+)?)(ms|s)>?)?", line.strip()):
            out.append(_result(m[1], {"ok": "passed", "FAILED": "failed", "ignored": "skipped"}[m[2]], duration_ms=_ms(m[3], m[4]), suite=suite))

    def said(lines: list[str]) -> str:
        for i, x in enumerate(lines):
            if "panicked at" in x:
                return next((y.strip() for y in lines[i + 1 :] if y.strip() and not y.startswith("note:")), x.strip()) if x.rstrip().endswith(":") else x.strip()
        return lines[-1].strip()

    out.attach(blocks, lambda a, b: a == b, said, lambda b: [b])


def pytest(lines: Iterable[str], out: Results) -> None:
    blocks, block, found = [], None, None
    for line in lines:
        if m := re.match(r"_{3,} (?:ERROR at \w+ of )?(\S.*?) _{3,}$", line):
            block = (m[1], [])
            blocks.append(block)
            continue
        if block is not None:
            if not line.startswith("==="):
                block[1].append(line)
                continue
            block = None
        if m := re.match(r"(\S+::.+?) (PASSED|FAILED|ERROR|SKIPPED|XFAIL|XPASS)\b", line):
            status = {"FAILED": "failed", "ERROR": "errored", "SKIPPED": "skipped", "XFAIL": "skipped"}.get(m[2], "passed")
            at = out.append(_result(m[1], status, file=m[1].split("::")[0]))
            if found is not None:
                found.setdefault(m[1], at)
        elif m := re.match(r"(FAILED|ERROR) (\S+::\S+)(?: - (.*))?$", line):
            if found is None:  # names are looked up from here on
                found = {}
                for at, name in enumerate(out.names()):
                    found.setdefault(name, at)
            if m[2] not in found:
                found[m[2]] = out.append(_result(m[2], "failed" if m[1] == "FAILED" else "errored", file=m[2].split("::")[0]))
            out.change(found[m[2]], message=m[3] or out.get(found[m[2]], "message"))
    last = lambda lines: next((x[1:].strip() for x in lines if x.startswith("E ")), lines[-1].strip())
    out.attach(blocks, lambda a, b: a.endswith(b.replace(".", "::")) or b in a, last)


def jest(lines: Iterable[str], out: Results) -> None:
    blocks, block, suite = [], None, None
    for line in lines:
        if m := re.match(r"\s?(PASS|FAIL)\s+(\S.*)$", line):
            suite, block = m[2].strip(), None
        elif m := re.match(r"\s*●\s+(.+)$", line):
            block = (m[1].strip(), [])
            blocks.append(block)
        elif m := re.match(r"\s*([✓√✕×○◌])\s+(?:skipped\s+)?(.+?)(?: \((\d+(?:\.\d+)?) ?(ms|s)\))?$", line):
            block = None
            status = "passed" if m[1] in "✓√" else "skipped" if m[1] in "○◌" else "failed"
            out.append(_result(m[2].strip(), status, duration_ms=_ms(m[3], m[4]), file=suite, suite=suite))
        elif re.match(r"(Tests|Test Suites):\s", line):
            block = None
        elif block is not None:
            block[1].append(line)
    parts = lambda b: [b, *(b[m.start() + 3 :] for m in re.finditer("(?= › )", b))]
    out.attach(blocks, lambda a, b: b == a or b.endswith(" › " + a), lambda lines: lines[0].strip(), parts)


def gotest(lines: Iterable[str], out: Results) -> None:
    held, last = [], None
    for line in lines:
        if m := re.match(r"\s*--- (PASS|FAIL|SKIP): (\S+) \((\d+(?:\.\d+)?)s\)", line):
            r = _result(m[2], {"PASS": "passed", "FAIL": "failed", "SKIP": "skipped"}[m[1]], duration_ms=_ms(m[3]))
            if held and r["status"] == "failed":
                r["stdout"] = "\n".join(held)
                r["message"] = held[-1]
            last = out.append(r)
            held = []
        elif re.match(r"=== (RUN|PAUSE|CONT|NAME)", line):
            held = []
        elif m := re.match(r"(?:FAIL|ok  )\t(\S+)", line):
            out.suites.append((len(out), m[1]))
        elif line.startswith("    ") and line.strip():
            if last is not None and not held and out.get(last, "status") == "failed" and not out.get(last, "message"):
                out.change(last, message=line.strip(), stdout=line.strip())
            held.append(line.strip())


def tap(lines: Iterable[str], out: Results) -> None:
    failing, notes = None, []

    def close():
        if failing is not None and notes:
            out.change(failing, stdout="\n".join(notes), message=notes[-1])

    for line in lines:
        t = line.strip()
        if m := re.match(r"Bail out!\s*(.*)", t):
            close()
            out.append(_result("Bail out!", "errored", message=m[1] or None))
            return
        if m := re.match(r"(not )?ok\b(?:\s+(\d+))?(?:\s+-)?\s*([^#]*?)\s*(?:#\s*(SKIP|TODO)\b.*)?$", t, re.I):
            close()
            status = "skipped" if m[4] else "failed" if m[1] else "passed"
            r = _result(m[3] or f"test {m[2] or len(out) + 1}", status)
            at = out.append(r)
            failing, notes = (at if status == "failed" else None), []
        elif failing is not None and t not in ("---", "...") and t and not t.startswith("1.."):
            notes.append(t.lstrip("# "))
    close()


def flutter(lines: Iterable[str], out: Results) -> None:
    seen, passed, failed = set(), 0, 0
    for line in lines:
        m = re.match(r"\d{2}:\d{2}\s+\+(\d+)(?:\s+-(\d+))?(?:\s+~(\d+))?\s*:\s+(.+)$", line)
        if not m:
            continue
        p, f, name = int(m[1]), int(m[2] or 0), m[4].strip()
        if not (name.startswith(("loading", "Some tests failed")) or name == "All tests passed!" or name in seen):
            seen.add(name)
            out.append(_result(name, "failed" if f > failed else "passed" if p > passed else "skipped"))
        passed, failed = p, f


def _without_doctype(lines: Iterable[str]) -> Iterator[str]:
    """The text of lines in pieces, from its first ink on and without DOCTYPE declarations."""
    held, inked, piece, size = "", False, [], 0
    for line in lines:
        text = held + line + "\n"
        held = ""
        if not inked:
            text = text.lstrip()
            inked = bool(text)
        if "<!DOCTYPE" in text:
            text = re.sub(r"<!DOCTYPE[^>]*>", "", text)
            if (at := text.find("<!DOCTYPE")) >= 0:
                text, held = text[:at], text[at:]
        piece.append(text)
        size += len(text)
        if size > 1 << 16:
            yield "".join(piece)
            piece, size = [], 0
    yield "".join([*piece, held])


def junit(lines: Iterable[str], out: Results) -> None:
    """By an XML parser: attributes are told apart by name, whatever their order. Elements are let go as they end."""
    parser = ET.XMLPullParser(("start", "end"))
    open_: list[tuple[ET.Element, str | None, bool, bool]] = []  # element, suite, whether cases count in it, whether within a case

    def read():
        for event, e in parser.read_events():
            if event == "start":
                _, suite, holds, within = open_[-1] if open_ else (None, None, True, False)
                own = e.tag == "testsuite" and holds
                case = e.tag == "testcase" and holds and bool(open_)
                open_.append((e, (e.get("name") or suite) if own else suite, own or not open_, within or case))
                continue
            open_.pop()
            above, suite, holds, within = open_[-1] if open_ else (None, None, False, False)
            if e.tag == "testcase" and holds:
                case_result(e, suite)
            if above is not None and not within:
                above.remove(e)

    def case_result(c: ET.Element, suite: str | None):
        bad = {k.tag: k for k in c}
        status = "failed" if "failure" in bad else "errored" if "error" in bad else "skipped" if "skipped" in bad else "passed"
        k = bad.get({"failed": "failure", "errored": "error", "skipped": "skipped"}.get(status, ""))
        said = None if k is None else k.get("message") or (k.text or "").strip() or None
        name = f"{c.get('classname')}::{c.get('name')}" if c.get("classname") else c.get("name", "")
        texts = {x: (bad[x].text or "").strip() or None for x in ("system-out", "system-err") if x in bad}
        out.append(_result(name, status, duration_ms=_ms(c.get("time")), file=c.get("file"), line=int(c.get("line")) if (c.get("line") or "").isdigit() else None, message=said, stdout=texts.get("system-out"), stderr=texts.get("system-err"), suite=suite))

    for piece in _without_doctype(lines):
        parser.feed(piece)
        read()
    parser.close()
    read()


def _json_lines(lines: Iterable[str]) -> Iterator[dict]:
    for line in lines:
        if line.strip().startswith("{"):
            try:
                v = json.loads(line)
            except ValueError:
                continue
            if isinstance(v, dict):
                yield v


def libtest_json(lines: Iterable[str], out: Results) -> None:
    status = {"ok": "passed", "failed": "failed", "ignored": "skipped", "timeout": "errored"}
    for v in _json_lines(lines):
        if v.get("type") == "test" and v.get("event") in status:
            out.append(_result(v.get("name", ""), status[v["event"]], duration_ms=_ms(str(v["exec_time"]).rstrip("s")) if v.get("exec_time") is not None else None, stdout=v.get("stdout"), message=v.get("message") or ((v.get("stdout") or "").strip().split("\n")[-1] or None)))


def gotest_json(lines: Iterable[str], out: Results) -> None:
    said = {}
    for v in _json_lines(lines):
        key = (v.get("Package"), v.get("Test"))
        if not v.get("Test"):
            continue
        if v.get("Action") == "output":
            said[key] = said.get(key, "") + v.get("Output", "")
        elif v.get("Action") in ("pass", "fail", "skip"):
            text_ = said.pop(key, "").strip() or None
            bad = v["Action"] == "fail"
            note = [x.strip() for x in (text_ or "").split("\n") if x.strip() and not x.strip().startswith(("===", "---"))]
            out.append(_result(v["Test"], {"pass": "passed", "fail": "failed", "skip": "skipped"}[v["Action"]], duration_ms=_ms(str(v["Elapsed"])) if v.get("Elapsed") is not None else None, suite=v.get("Package"), stdout=text_ if bad else None, message=note[-1] if bad and note else None))


PARSERS: dict[str, Callable[[Iterable[str], Results], None]] = {"libtest": libtest, "libtest_json": libtest_json, "pytest": pytest, "junit": junit, "jest": jest, "gotest": gotest, "gotest_json": gotest_json, "tap": tap, "flutter": flutter, "unknown": lambda lines, out: None}


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of rows (run_id, first, format, line): a run's lines follow the row that is its first and has its format."""
    rows = (r for b in batches for k in range(0, b.num_rows, 4096) for r in zip(*(c.to_pylist() for c in b.slice(k, 4096).select(["run_id", "first", "format", "line"]).columns)))
    ahead = next(rows, None)

    def lines() -> Iterator[str]:
        """The lines of the run at hand; the row after them is left ahead."""
        nonlocal ahead
        while ahead is not None:
            if ahead[3] is not None:
                yield ahead[3]
            ahead = next(rows, None)
            if ahead is not None and ahead[1]:
                return

    while ahead is not None:
        run_id, _, fmt, _ = ahead
        out, own = Results(), lines()
        try:
            PARSERS[fmt](own if fmt == "junit" else (x for line in own for x in (line + "\n").splitlines()), out)
        except (ET.ParseError, ValueError):
            out = Results()
        for _ in own:  # what a parser left
            pass
        yield from out.batches(run_id, fmt)


def parse(runs: DataFrame, format: str | None = None) -> DataFrame:
    """Results of (run_id, content); the format is detected run by run unless one is named. A text that
    its parser refuses has no results."""
    chosen = FORMAT_ALIASES.get(format, format)
    runs = runs.select("run_id", "content").where("content is not null")
    if chosen in PARSERS:
        runs = runs.withColumn("format", F.lit(chosen))
    else:
        runs = runs.join(detect(runs), "run_id")
    lines = runs.select("run_id", "format", F.posexplode(F.split("content", "\n")).alias("k", "line"))
    return lines.select("run_id", (F.col("k") == 0).alias("first"), "format", "line").mapInArrow(_parsed, RESULT)


def parse_lines(lines: DataFrame, format: str | None = None) -> DataFrame:
    """Results of runs given by their lines (run_id, ord, line), as parse() has them: a run's lines are sorted
    where they meet, and no text of it is made."""
    chosen = FORMAT_ALIASES.get(format, format)
    lines = lines.select("run_id", F.col("ord").cast("bigint").alias("ord"), "line").where("line is not null")
    formats = lines.select("run_id").distinct().withColumn("format", F.lit(chosen)) if chosen in PARSERS else detect_lines(lines)
    none = F.lit(None).cast("string")
    rows = formats.select("run_id", F.lit(True).alias("first"), F.lit(0).cast("bigint").alias("ord"), "format", none.alias("line")).unionAll(lines.select("run_id", F.lit(False), "ord", none, "line"))
    # by a hash: a shuffle by run_id itself would be left out where both sides of the union have had one, which adaptive plans then coalesce apart
    placed = rows.repartition(F.xxhash64("run_id")).sortWithinPartitions("run_id", F.desc("first"), "ord", "line")
    return placed.select("run_id", "first", "format", "line").mapInArrow(_parsed, RESULT)


def read(spark: SparkSession, paths: str | list[str], format: str | None = None) -> DataFrame:
    """Results of files, a run a file."""
    return parse(spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("run_id"), F.col("value").alias("content")), format)
