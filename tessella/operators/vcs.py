"""History of a repository as tables.

commits(hash, ord, author, ts, message): ord 0 is the newest, ts in seconds;
commit_files(hash, status, path, insertions, deletions), against the first parent.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "hash string, ord int, author string, ts bigint, message string"
FILES = "hash string, status string, path string, insertions bigint, deletions bigint"


def parse_date(text: str, now: datetime | None = None) -> int:
    """Seconds of a date, an RFC 3339 time, or `3 days` (weeks, months of 30 days, hours) before now."""
    now = now or datetime.now(UTC)
    m = re.fullmatch(r"(\d+)\s*(hour|day|week|month|year)s?(?:\s+ago)?", text.strip())
    if m:
        hours = {"hour": 1, "day": 24, "week": 168, "month": 720, "year": 8760}[m[2]]
        return int((now - timedelta(hours=int(m[1]) * hours)).timestamp())
    when = datetime.fromisoformat(text)
    return int((when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp())


def _touching(files: DataFrame, paths: list[str] | None) -> DataFrame:
    if not paths:
        return files
    keep = F.lit(False)
    for p in paths:
        keep = keep | (F.col("path") == p) | F.col("path").startswith(p.rstrip("/") + "/")
    return files.where(keep)


def log(commits: DataFrame, files: DataFrame, count: int = 20, paths: list[str] | None = None) -> DataFrame:
    """(hash of 8, author, ts, summary, files): the newest commits that touch one of the paths, each with
    all its files."""
    if paths:
        commits = commits.join(_touching(files, paths).select("hash").distinct(), "hash", "left_semi")
    newest = commits.orderBy("ord").limit(count)
    listed = files.join(newest.select("hash"), "hash", "left_semi").groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("path", "status"))).alias("f"))
    out = newest.join(listed, "hash", "left").orderBy("ord")
    shape = F.transform("f", lambda x: F.struct(x["status"].alias("status"), x["path"].alias("path")))
    return out.select(F.substring("hash", 1, 8).alias("hash"), "author", "ts", F.split("message", "\n")[0].alias("summary"), F.coalesce(shape, F.array().cast("array<struct<status:string,path:string>>")).alias("files"))


def churn(commits: DataFrame, files: DataFrame, since: int | None = None, paths: list[str] | None = None) -> DataFrame:
    """(path, commits, insertions, deletions), most commits first. The walk from the newest commit on
    stops at the first that is older than since."""
    if since is not None:
        stop = commits.where(F.col("ts") < since).agg(F.min("ord").alias("stop"))
        commits = commits.crossJoin(F.broadcast(stop)).where("stop is null or ord < stop")  # one row
        files = files.join(commits.select("hash"), "hash", "left_semi")
    out = _touching(files, paths).groupBy("path").agg(F.count_distinct("hash").alias("commits"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))
    return out.orderBy(F.desc("commits"), "path")


def changed_since(commits: DataFrame, files: DataFrame, rev_or_date: str) -> DataFrame:
    """(path, change_count): files changed after a revision, or if there is none of that name, since a date."""
    hit = commits.where(F.col("hash").startswith(rev_or_date)).agg(F.min("ord").alias("stop"))
    found = hit.first()[0] if re.fullmatch(r"[0-9a-f]{4,64}", rev_or_date) else None
    if found is None:
        found = commits.where(F.col("ts") < parse_date(rev_or_date)).agg(F.min("ord")).first()[0]
    recent = commits if found is None else commits.where(F.col("ord") < found)
    return files.join(recent.select("hash"), "hash", "left_semi").groupBy("path").agg(F.count("*").alias("change_count")).orderBy(F.desc("change_count"), "path")


def parse_range(text: str) -> tuple[str, str]:
    """A..B, or A for A..HEAD."""
    a, dots, b = text.partition("..")
    return a, (b or "HEAD") if dots else "HEAD"


# The source: one repository's output of git, streamed to rows.


def _git(repo: str, *args: str) -> Iterator[str]:
    with subprocess.Popen(["git", "-c", "safe.directory=*", "-C", repo, *args], stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, errors="replace") as p:
        yield from p.stdout
        error = p.stderr.read()
    if p.returncode:
        raise ValueError(error.strip())


def _numstat(line: str) -> tuple[int, int, str] | None:
    m = re.fullmatch(r"(\d+|-)\t(\d+|-)\t(.*)\n?", line)
    return (0 if m[1] == "-" else int(m[1]), 0 if m[2] == "-" else int(m[2]), m[3]) if m else None


def _history(repo: str) -> Iterator[tuple[str, tuple]]:
    commit, order, status, stats = None, -1, {}, {}

    def files():
        for path, s in status.items():
            ins, gone = stats.get(path, (0, 0))
            yield "file", (commit, s, path, ins, gone)

    for line in _git(repo, "-c", "core.quotepath=off", "log", "--first-parent", "--diff-merges=first-parent", "--no-renames", "--raw", "--numstat", "--format=%x01%H%x02%an%x02%ct%x02%B%x03"):
        if line.startswith("\x01"):
            yield from files()
            order, status, stats, text = order + 1, {}, {}, line[1:]
            commit = None
        elif commit is None:
            text += line
        elif m := re.match(r":\d+ \d+ \S+ \S+ ([A-Z])\d*\t(.*)\n?", line):
            status[m[2]] = m[1]
        elif n := _numstat(line):
            stats[n[2]] = n[:2]
        if commit is None and "\x03" in text:
            commit, author, ts, message = text.split("\x03")[0].split("\x02")
            yield "commit", (commit, order, author, int(ts), message.strip())
    yield from files()


def read_history(spark: SparkSession, repo: str) -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files) of a repository, from HEAD along first parents."""
    rows = {"commit": [], "file": []}
    for kind, row in _history(repo):
        rows[kind].append(row)
    return spark.createDataFrame(rows["commit"], COMMITS), spark.createDataFrame(rows["file"], FILES)


def diff(spark: SparkSession, repo: str, range_text: str, files_only: bool = False, paths: list[str] | None = None) -> DataFrame:
    """(path, insertions, deletions) by size of the change, or (path) alone."""
    a, b = parse_range(range_text)
    rows = [(n[2], n[0], n[1]) for line in _git(repo, "-c", "core.quotepath=off", "diff", "--numstat", "--no-renames", f"{a}..{b}", "--", *(paths or [])) if (n := _numstat(line))]
    out = spark.createDataFrame(rows, "path string, insertions bigint, deletions bigint").orderBy(F.desc(F.col("insertions") + F.col("deletions")), "path")
    return out.select("path") if files_only else out


def blame(spark: SparkSession, repo: str, path: str) -> DataFrame:
    """(line, hash, author, timestamp, content)."""
    rows, cur, known = [], {}, {}
    for line in _git(repo, "blame", "--line-porcelain", "--", path):
        if line.startswith("\t"):
            rows.append((cur["line"], cur["hash"][:8], cur.get("author"), cur.get("ts"), line[1:].rstrip("\n")))
        elif m := re.match(r"([0-9a-f]{40}) \d+ (\d+)", line):
            cur = {"hash": m[1], "line": int(m[2]), **known.get(m[1], {})}
        elif line.startswith("author "):
            cur["author"] = line[7:].strip()
        elif line.startswith("author-time "):
            cur["ts"] = int(line[12:])
    return spark.createDataFrame(rows, "line int, hash string, author string, timestamp bigint, content string")


def content_at(repo: str, rev: str, path: str) -> str:
    return "".join(_git(repo, "show", f"{rev}:{path}"))
