"""Version history through the git program, as a Spark data source.

spark.read.format("git_refs") lists (walk_seq, commit, commit_time, path, object_name) newest first;
spark.read.format("git_blobs") with option "names" reads (object_name, kind, size, content). Both take "path".
"""

from __future__ import annotations

import os
import subprocess
import threading
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import fixed as X
from ..operators import history, paths
from ..plans.detect import Options, detect
from ..rules import RULES, Rule
from .files import Walk, judged

TIMEOUT = 300
BLOBS = "object_name string, kind string, size long, content binary"
SAFE = ["-c", "core.fsmonitor=false", "-c", "core.hooksPath=/dev/null", "-c", "core.quotePath=false", "-c", "protocol.allow=never", "-c", "safe.directory=*"]


class GitError(RuntimeError):
    """A failure of git, with a code: git-unavailable, not-a-git-repository, git-timeout, git-failed."""

    def __init__(self, code: str, reason: str):
        super().__init__(f"{code}: {reason}")
        self.code = code


def _environment() -> dict[str, str]:
    """No inherited settings of git, no prompts."""
    return {k: v for k, v in os.environ.items() if not k.startswith("GIT_")} | {"GIT_TERMINAL_PROMPT": "0", "GIT_CONFIG_NOSYSTEM": "1", "LC_ALL": "C", "GIT_OPTIONAL_LOCKS": "0"}


def git(repo: str, *arguments: str, feed: bytes | None = None, timeout: int = TIMEOUT) -> bytes:
    """git's output; no shell, no inherited settings, no prompts."""
    try:
        run = subprocess.run(["git", *SAFE, "-C", repo, *arguments], input=feed if feed is not None else b"", capture_output=True, env=_environment(), timeout=timeout)
    except FileNotFoundError as e:
        raise GitError("git-unavailable", "there is no git program") from e
    except subprocess.TimeoutExpired as e:
        raise GitError("git-timeout", f"git took more than {timeout} s") from e
    if run.returncode:
        raise GitError("not-a-git-repository" if b"not a git repository" in run.stderr else "git-failed", f"git ended with {run.returncode}")
    return run.stdout


def head_state(repo: str) -> str:
    """present, unborn (no commit yet) or invalid."""
    try:
        git(repo, "rev-parse", "--git-dir")
    except GitError as e:
        if e.code in ("git-unavailable", "git-timeout"):
            raise
        return "invalid"
    try:
        git(repo, "rev-parse", "--verify", "--quiet", "HEAD^{commit}")
    except GitError:
        return "unborn"
    return "present"


@contextmanager
def piped(repo: str, *arguments: str, feed: Iterable[bytes] = (), timeout: int = TIMEOUT) -> Iterator[BinaryIO]:
    """git's output as a stream, fed by a thread of its own, so that neither side is held whole; ended after `timeout` seconds."""
    try:
        run = subprocess.Popen(["git", *SAFE, "-C", repo, *arguments], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=_environment())
    except FileNotFoundError as e:
        raise GitError("git-unavailable", "there is no git program") from e
    late = threading.Event()

    def end() -> None:
        late.set()
        run.kill()

    def write() -> None:
        try:
            with run.stdin:
                for piece in feed:
                    run.stdin.write(piece)
        except (BrokenPipeError, ValueError):
            pass  # git ended first; its exit status tells why

    clock, writer = threading.Timer(timeout, end), threading.Thread(target=write, daemon=True)
    clock.start()
    writer.start()
    whole = False
    try:
        yield run.stdout
        whole = not run.stdout.read(1)
    finally:
        clock.cancel()
        if not whole:
            run.kill()
        run.stdout.close()
        status = run.wait()
        writer.join(5)
        if late.is_set():
            raise GitError("git-timeout", f"git took more than {timeout} s")
    if whole and status:
        raise GitError("git-failed", f"git ended with {status}")


def _fields(stream: BinaryIO, size: int = 1 << 16) -> Iterator[bytes]:
    """What stands between zero bytes."""
    rest = b""
    while piece := stream.read(size):
        *whole, rest = (rest + piece).split(b"\0")
        yield from whole
    yield rest


def parse_log(raw: bytes | BinaryIO) -> Iterator[tuple[int, str, int, str, str]]:
    """Rows of `log --raw -z` with a line of \\x01, commit and time before each commit's changes."""
    seq, commit, when = 0, "", 0
    fields = iter(raw.split(b"\0")) if isinstance(raw, bytes) else _fields(raw)
    for f in fields:
        f = f.lstrip(b"\n")
        if f.startswith(b"\x01"):
            commit_, when_ = f[1:].split(b" ")[:2]
            commit, when = commit_.decode(), int(when_)
        elif f.startswith(b":"):
            parts = f.split(b" ")
            name = next(fields, None)
            if name is None or len(parts) < 4:
                raise GitError("git-malformed-output", "the log ends within a change")
            new = parts[3].decode()
            if set(new) != {"0"} and parts[1] not in (b"160000", b"120000"):
                yield seq, commit, when, name.decode("utf-8", "replace"), new
                seq += 1


def inventory(repo: str, timeout: int = TIMEOUT) -> Iterator[tuple[str, str]]:
    """(object_name, path) of everything that HEAD reaches, each object once, in git's order."""
    if head_state(repo) != "present":
        return
    with piped(repo, "rev-list", "--objects", "HEAD", timeout=timeout) as out:
        for line in out:
            name, _, path = line.rstrip(b"\n").partition(b" ")
            yield name.decode(), path.decode("utf-8", "replace")


def headers(repo: str, names: Sequence[str], timeout: int = TIMEOUT) -> Iterator[tuple[str, str | None, int | None]]:
    """(name, kind, size) of each name in order; nulls for one that is missing."""
    with piped(repo, "cat-file", "--batch-check", feed=(n.encode() + b"\n" for n in names), timeout=timeout) as out:
        for name in names:
            parts = out.readline().split()
            if not parts:
                raise GitError("git-malformed-output", "an object's header is not there")
            yield (name, parts[1].decode(), int(parts[2])) if len(parts) == 3 else (name, None, None)


def payloads(repo: str, names: Sequence[str], timeout: int = TIMEOUT) -> Iterator[tuple[str, bytes]]:
    """(name, content) of names that are there: one process, one content held at a time."""
    with piped(repo, "cat-file", "--batch", feed=(n.encode() + b"\n" for n in names), timeout=timeout) as out:
        for name in names:
            parts = out.readline().split()
            if len(parts) != 3:
                raise GitError("git-malformed-output", "an object went between its header and its content")
            size = int(parts[2])
            content = out.read(size)
            if len(content) != size or out.read(1) != b"\n":
                raise GitError("git-malformed-output", "an object's content is cut")
            yield name, content


def objects(repo: str, names: Sequence[str], most: int = X.MAX_FILE_BYTES, timeout: int = TIMEOUT) -> Iterator[tuple[str, str | None, int | None, bytes | None]]:
    """(name, kind, size, content) by two processes; no content for what is missing, no blob, or larger than most."""
    if not names:
        return
    wanted = []
    for name, kind, size in headers(repo, names, timeout):
        if kind == "blob" and size <= most:
            wanted.append(name)
        else:
            yield name, kind, size, None
    if wanted:
        for name, content in payloads(repo, wanted, timeout):
            yield name, "blob", len(content), content


class _Refs(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        repo = self.options["path"]
        if head_state(repo) != "present":
            return
        more = [f"--{k}={self.options[k]}" for k in ("since", "until") if k in self.options]
        most = int(self.options.get("maxrefs", -1))
        with piped(repo, "log", "--raw", "-z", "--no-renames", "--root", "-m", "--no-abbrev", "--format=%x01%H %at", *more, "HEAD", timeout=int(self.options.get("timeout", TIMEOUT))) as out:
            for row in parse_log(out):
                yield row
                if row[0] == most:  # one more than most tells that there are more
                    return


class _Blobs(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        names = self.options.get("names", "").split()
        size = max(1, int(self.options.get("pernames", "500")))
        return [InputPartition(names[i : i + size]) for i in range(0, len(names), size)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from objects(self.options["path"], partition.value, int(self.options.get("maxbytes", X.MAX_FILE_BYTES)), int(self.options.get("timeout", TIMEOUT)))


class GitRefs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_refs"

    def schema(self) -> str:
        return "walk_seq long, commit string, commit_time long, path string, object_name string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Refs(dict(self.options))


class GitBlobs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_blobs"

    def schema(self) -> str:
        return BLOBS

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Blobs(dict(self.options))


def staged(repo: str) -> Walk:
    """The files that are added, copied, changed or renamed in the index, as they lie in the work tree."""
    root = os.path.realpath(git(repo, "rev-parse", "--show-toplevel").decode().rstrip("\n"))
    out = Walk(root)
    for raw in git(root, "diff", "--cached", "--name-only", "-z", "--diff-filter=ACMR").split(b"\0"):
        path = os.fsdecode(raw)
        file = os.path.join(root, path)
        if path and os.path.isfile(file) and not os.path.islink(file):
            out.files.append((path, file, os.path.getsize(file)))
    out.files.sort()
    return out


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitRefs)
    spark.dataSource.register(GitBlobs)


#: Bytes of content that a batch of blobs aims at, and names that one pair of processes reads.
BATCH_BYTES, NAMES = 8_000_000, 2000


def read_blobs(names: DataFrame, repo: str, most: int = X.MAX_FILE_BYTES, timeout: int = TIMEOUT) -> DataFrame:
    """names (object_name) to object_name, kind, size, content, where the names are: they don't pass the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = b.column(0).to_pylist()
            for at in range(0, len(got), NAMES):
                rows, size = [], 0
                for row in objects(repo, got[at : at + NAMES], most, timeout):
                    rows.append(row)
                    size += len(row[3] or b"")
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return names.select("object_name").mapInArrow(run, BLOBS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in BLOBS.split(", ")])


class History(NamedTuple):
    """Findings at every path of every distinct blob; a row a blob (object_name, kind, size, status); errors (path, code,
    reason), among them each limit that cut the scan; one row of counters."""

    findings: DataFrame
    status: DataFrame
    errors: DataFrame
    counters: DataFrame


def scan_history(
    spark: SparkSession,
    repo: str,
    rules: Sequence[Rule] = RULES,
    options: Options = Options(),
    *,
    max_commits: int | None = None,
    max_blobs: int = X.MAX_BLOBS,
    max_refs: int = X.MAX_REFS,
    since: str | None = None,
    until: str | None = None,
    path_filters: bool = False,
    ignored_paths: Sequence[str] = (),
    timeout: int = TIMEOUT,
) -> History:
    """Scan each distinct blob of a history once. Limits keep the newest; what they cut is told in errors.

    Paths are reported without controls and '..'; a path with nothing left, or longer than MAX_PATH, is dropped and told.
    path_filters skips what a folder scan would skip by name.
    """
    if not 1 <= timeout <= 3600:
        raise ValueError("a timeout is between 1 and 3600 seconds")
    for text in (since, until):
        if text is not None and (len(text) > X.MAX_DATE or text.startswith("-")):
            raise ValueError("not a date")
    register(spark)
    reader = spark.read.format("git_refs").option("maxrefs", max_refs).option("timeout", timeout)
    for name, value in (("since", since), ("until", until)):
        reader = reader.option(name, value) if value is not None else reader
    # bounded by max_refs, read once by git; all that follows reads it again
    walked = reader.load(repo).persist()
    refs = walked.where(F.col("walk_seq") < max_refs)
    cuts = [walked.agg(F.coalesce(F.max("walk_seq") >= max_refs, F.lit(False)).alias("cut")).select("cut", F.lit(f"only the newest {max_refs} references are read").alias("reason"))]
    if max_commits is not None:
        refs, cut = history.first_commits(refs, max_commits)
        cuts.append(cut.select(F.col("truncated").alias("cut"), F.lit(f"only the newest {max_commits} commits are read").alias("reason")))
    named = refs.withColumn("path", paths.report_path(F.col("path")))
    cuts.append(named.agg(F.coalesce(F.bool_or(F.col("path").isNull()), F.lit(False)).alias("cut")).select("cut", F.lit("paths that can't be reported are left out").alias("reason")))
    named = named.where("path is not null")
    skipped = paths.skip_reason_with_parents(F.col("path"), ignored_paths=ignored_paths).isNotNull() if path_filters else F.lit(False)
    inside = named.where(~skipped)
    kept = history.first_blobs(inside, max_blobs)
    cuts.append(inside.agg((F.count_distinct("object_name") > max_blobs).alias("cut")).select("cut", F.lit(f"only the newest {max_blobs} objects are read").alias("reason")))

    names = kept.select("object_name").distinct()
    read = read_blobs(names, repo, timeout=timeout)
    # texts serve both the findings and the status: git reads a blob once unless an executor is lost
    code = judged(read.select(F.col("object_name").alias("path"), "content", F.col("size").alias("length"), "kind"), keep=("kind",)).persist()
    units = code.where("text is not null").select(F.col("path").alias("unit_id"), "path", "text")
    found = detect(units, rules, options).withColumnRenamed("path", "object_name").withColumn("path", F.lit(None).cast("string"))
    status = history.blob_status(names, code.select(F.col("path").alias("object_name"), "kind", "size", "code"), carry=("code",))
    status = status.select("object_name", "kind", "size", F.when(F.col("status") == "readable", F.coalesce("code", F.lit("scanned"))).otherwise(F.col("status")).alias("status"))
    errors = status.where("status = 'missing'").select("object_name", F.lit("object-unreadable").alias("code"), F.lit("an object can't be read").alias("reason"))
    for c in cuts:
        errors = errors.union(c.where("cut").select(F.lit(None).cast("string"), F.lit("history-truncated"), "reason"))
    errors = errors.toDF("path", "code", "reason")
    counters = history.counters(status, refs, named.where(skipped))
    return History(history.fan_out(found, history.blob_paths(kept)), status, errors, counters)
