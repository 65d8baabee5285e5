"""Python that runs inside Spark tasks.  Shipped by value (see ``rowloom/__init__``),
so executors need no installed copy of this package.

All of it works on the batch stream of one partition and keeps one batch in memory.
"""

from __future__ import annotations

import re

# A CSV field that begins at a field start: quoted (closing quote, then stray text up
# to the comma), plain (quotes inside are ordinary characters), or empty.
_FIELDS = r'(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|),)*+'
_OPENING = r'"(?:[^"]++|"")*+\Z'
_OPEN_FROM_START = re.compile(_FIELDS + _OPENING)
_OPEN_FROM_QUOTE = re.compile(rf'(?:[^"]++|"")*+(?:\Z|"[^,]*+,{_FIELDS}{_OPENING})')


def ends_in_quote(piece: str, in_quote: bool) -> bool:
    """Is a quoted field still open after this line, given how the line began?"""
    if '"' not in piece:
        return in_quote
    pattern = _OPEN_FROM_QUOTE if in_quote else _OPEN_FROM_START
    return pattern.match(piece) is not None


def line_pieces(line: str) -> list[str]:
    """Split one ``\\n``-line at carriage returns that stand alone."""
    body = line[:-1] if line.endswith("\r") else line
    return body.split("\r") if "\r" in body else [body]


def walk_line(line: str, in_quote: bool) -> tuple[bool, int]:
    """(open after the line, records that begin in the line)."""
    begun = 0
    for piece in line_pieces(line):
        begun += not in_quote
        in_quote = ends_in_quote(piece, in_quote)
    return in_quote, begun


def summarize_quotes(batches):
    """Reduce the lines that hold quotes to one row per input block.

    Input columns: file, start, m, value.  A block's first line may lie inside a quoted
    field, so each figure is worked out for both cases (suffix 0 closed, 1 open):
    ``out`` state after the last of these lines, ``recs`` records begun between the first
    and the last of them.  ``close_m`` is the first line after which an open start is
    closed (-1: never) and ``head_recs`` the records begun up to and including that line.
    ``odd``: in the closed case some line is not exactly one record.
    """
    import pyarrow as pa

    schema = pa.schema(
        [("file", pa.string())]
        + [(name, pa.int64()) for name in ("start", "first_m", "last_m", "out0", "recs0", "out1", "recs1")]
        + [("close_m", pa.int64()), ("head_recs", pa.int64()), ("odd", pa.bool_())]
    )
    block = None

    def flush():
        return pa.RecordBatch.from_pylist([block], schema=schema)

    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("file", "start", "m", "value")]
        for file, start, m, value in zip(*columns):
            if block is None or block["start"] != start or block["file"] != file:
                if block is not None:
                    yield flush()
                block = dict(file=file, start=start, first_m=m, last_m=m - 1, out0=0, recs0=0,
                             out1=1, recs1=0, close_m=-1, head_recs=0, odd=False)
            gap = m - block["last_m"] - 1
            for case in ("0", "1"):
                state = block["out" + case]
                out, begun = walk_line(value, bool(state))
                block["recs" + case] += begun + (0 if state else gap)
                block["out" + case] = int(out)
                if case == "0":
                    block["odd"] |= state == 1 or out or begun != 1
            if block["close_m"] < 0:
                block["head_recs"] = block["recs1"]
                if not block["out1"]:
                    block["close_m"] = m
            block["last_m"] = m
    if block is not None:
        yield flush()


class RecordJoiner:
    """Joins lines into CSV records.

    Only lines with quotes (or lone carriage returns) are looked at one by one; the runs of
    lines between them are records, or the inside of one field, as a whole.
    """

    def __init__(self, most):
        self.most = most  # characters of a record that spans lines
        self.pending = []  # pieces of the record that is still open
        self.open = 0  # their characters
        self.records = []  # Arrow arrays of finished records

    def feed(self, values):
        import pyarrow as pa
        import pyarrow.compute as pc

        looked_at = pc.or_(pc.match_substring(values, '"'), pc.match_substring_regex(values, "\\r(?s:.)"))
        at = 0
        for spot in pc.indices_nonzero(looked_at).to_pylist():
            self._run(values.slice(at, spot - at))
            done = self._line(values[spot].as_py())
            if done:
                self.records.append(pa.array(done, pa.string()))
            at = spot + 1
        self._run(values.slice(at))

    def _run(self, values):
        import pyarrow.compute as pc

        if len(values) and self.pending:
            self._keep("\n".join(values.to_pylist()) + "\n")
        elif len(values):
            self.records.append(pc.utf8_rtrim(values, "\r"))

    def _line(self, line):
        done = []
        pieces = line_pieces(line)
        for i, piece in enumerate(pieces):
            if ends_in_quote(piece, bool(self.pending)):
                last = i == len(pieces) - 1
                ending = ("\r\n" if line.endswith("\r") else "\n") if last else "\r"
                self._keep(piece + ending)
            else:
                done.append("".join(self.pending) + piece)
                self.pending, self.open = [], 0
        return done

    def _keep(self, piece):
        self.pending.append(piece)
        self.open += len(piece)
        if self.open > self.most:
            raise ValueError(f"a CSV record with an open quote has more than {self.most} characters: {self.pending[0][:200]!r}")

    def close(self):
        """A quote still open at the end of the file ends there."""
        import pyarrow as pa

        if self.pending:
            self.records.append(pa.array(["".join(self.pending)], pa.string()))
            self.pending, self.open = [], 0

    def take(self):
        import pyarrow as pa

        records, self.records = self.records, []
        return pa.concat_arrays(records) if records else pa.array([], pa.string())


def assemble_records(batches, most):
    """Join the lines of one partition into CSV records and number them.

    Input columns: value, tail, base, header, file.  ``tail`` is set on the last line of an
    input block: "+" and the lines of later blocks that complete its last record, or "-".  ``base``
    is the index of the block's first data row; ``header`` says that the block begins with
    a header record.  Output: value, row_idx, lead (first data row of the partition), file.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    schema = pa.schema([("value", pa.string()), ("row_idx", pa.int64()), ("lead", pa.bool_()), ("file", pa.string())])
    joiner = RecordJoiner(most)
    next_idx = file = None
    skip, lead = False, True

    def finished():
        nonlocal next_idx, skip, lead
        records = joiner.take()
        if skip and len(records):
            records, skip = records.slice(1), False
        size = len(records)
        numbers = pa.array(range(next_idx, next_idx + size), pa.int64())
        leads = pa.array([lead] + [False] * (size - 1) if size else [], pa.bool_())
        next_idx, lead = next_idx + size, lead and not size
        return pa.RecordBatch.from_arrays([records, numbers, leads, pa.array([file] * size, pa.string())], schema=schema)

    for batch in batches:
        tails = batch["tail"]
        at = 0
        for end in pc.indices_nonzero(pc.is_valid(tails)).to_pylist() + [batch.num_rows]:
            if at == batch.num_rows:
                break
            if next_idx is None:
                next_idx, skip, file = batch["base"][at].as_py(), batch["header"][at].as_py(), batch["file"][at].as_py()
            joiner.feed(batch["value"].slice(at, end + 1 - at))
            if end < batch.num_rows:
                tail = tails[end].as_py()
                if tail != "-":
                    joiner.feed(pa.array(tail[1:].split("\n"), pa.string()))
                joiner.close()
            yield finished()
            if end < batch.num_rows:
                next_idx = None
            at = end + 1
    if next_idx is not None:
        joiner.close()
        yield finished()


def shard_runs(frames):
    """Cut a stream of pandas batches into (shard_id, stream) runs of equal shard_id."""
    stream = (piece for frame in frames for piece in _cut(frame))
    head = next(stream, None)
    while head is not None:
        shard_id = head[0]
        following = []

        def run(first=head[1], shard_id=shard_id, following=following):
            yield first
            for other_id, piece in stream:
                if other_id != shard_id:
                    following.append((other_id, piece))
                    return
                yield piece

        pieces = run()
        yield shard_id, pieces
        for _ in pieces:  # what the caller left unread
            pass
        head = following[0] if following else None


def _cut(frame):
    ids = frame["shard_id"].to_numpy()
    start = 0
    while start < len(ids):
        shard_id = int(ids[start])
        changes = (ids[start:] != ids[start]).nonzero()[0]
        stop = start + int(changes[0]) if len(changes) else len(ids)
        yield shard_id, frame.iloc[start:stop].reset_index(drop=True)
        start = stop


def announce(attempt):
    """Tell the program about to run which attempt of its shard this is."""
    import os

    os.environ["ROWLOOM_ATTEMPT"] = str(attempt)


def side_path(side):
    """Where a task finds a side file: an absolute path is in the shared folder, a name was shipped by Spark."""
    import os

    from pyspark import SparkFiles

    return side if os.path.isabs(side) else SparkFiles.get(side)


def shard_worker(fn, names, side_name, whole, record, again=None):
    """Body of ``mapInPandas`` for the per-shard map; see ``operators.apply``.

    ``again``: partition k is not shard k but the k-th of these (shard, number of its first attempt).
    """
    firsts = dict(again or ())

    def work(frames):
        from pyspark import TaskContext

        context = TaskContext.get()
        extra = (side_path(side_name),) if side_name else ()
        empty = True
        for shard_id, pieces in shard_runs(frames):
            empty = False
            yield from run(shard_id, pieces, extra, context)
        if empty and whole:  # partition k is shard k: a shard without rows still runs
            part = context.partitionId()
            yield from run(again[part][0] if again else part, iter(()), extra, context)

    def run(shard_id, pieces, extra, context):
        import pandas as pd

        rows_out, error = 0, None
        attempt = firsts.get(shard_id, 0) + context.attemptNumber()
        announce(attempt)
        try:
            for out in fn(shard_id, (p.drop(columns="shard_id") for p in pieces), *extra):
                out = out[names].copy()
                rows_out += len(out)
                out.insert(0, "shard_id", shard_id)
                if record:
                    out = out.assign(_rowloom_attempt=None, _rowloom_status=None, _rowloom_error=None, _rowloom_rows_out=None)
                yield out
        except Exception as exc:
            if not record:
                raise
            error = f"{type(exc).__name__}: {exc}"
        if record:
            outcome = {name: [None] for name in names}
            outcome.update(shard_id=[shard_id], _rowloom_attempt=[attempt], _rowloom_error=[error],
                           _rowloom_status=["failed" if error else "ok"], _rowloom_rows_out=[rows_out])
            yield pd.DataFrame(outcome)

    return work


def hash_pieces(frames):
    """sha256 of byte ranges: rows of (path, rel_path, piece, offset, size) in, digests out."""
    import hashlib

    for frame in frames:
        digests = []
        for path, offset, size in zip(frame["path"], frame["offset"], frame["size"]):
            filesystem, inner = open_filesystem(path)
            digest = hashlib.sha256()
            with filesystem.open_input_file(inner) as source:
                source.seek(int(offset))
                left = int(size)
                while left:
                    data = source.read(min(left, 1 << 20))
                    if not data:
                        raise OSError(f"{path} is shorter than listed")
                    digest.update(data)
                    left -= len(data)
            digests.append(digest.hexdigest())
        yield frame[["rel_path", "piece"]].assign(digest=digests)


def open_filesystem(path):
    """(filesystem, inner path) of a path with or without scheme."""
    import os

    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), os.path.abspath(path)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    # Names of one store under several connectors.
    uri = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}.get(scheme, scheme) + ":" + rest
    return fs.FileSystem.from_uri(uri)


def write_shard_file(batches, folder, name, kind):
    """Write the rows of one partition to ``folder/name``; (name, 1, bytes, rows, sha256).

    ``text``: the lines of the column ``value``.  ``parquet``: all columns.  The file gets its name
    when it is whole, so that the attempts of a task do not meet.
    """
    import hashlib
    import uuid

    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    class Sink:
        """Counts and hashes what passes through."""

        closed = False

        def __init__(self, out):
            self.out, self.size, self.digest = out, 0, hashlib.sha256()

        def write(self, data):
            self.out.write(data)
            self.digest.update(data)
            self.size += len(data)
            return len(data)

        def tell(self):
            return self.size

        def flush(self):
            self.out.flush()

    filesystem, inner = open_filesystem(folder)
    part = f"{inner}/{uuid.uuid4().hex}.part"
    rows, writer = 0, None
    with filesystem.open_output_stream(part) as out:
        sink = Sink(out)
        for batch in batches:
            rows += batch.num_rows
            if kind == "text":
                lines = batch.column("value").cast(pa.large_string())
                closed = pc.binary_join_element_wise(pc.fill_null(lines, ""), *(pa.scalar(x, pa.large_string()) for x in ("", "\n")))
                first, last = closed.offset, closed.offset + len(closed)
                bounds = closed.buffers()[1].slice(8 * first, 8 * (len(closed) + 1))
                low, high = memoryview(bounds).cast("q")[0], memoryview(bounds).cast("q")[last - first]
                if high > low:
                    sink.write(memoryview(closed.buffers()[2])[low:high])
            else:
                writer = writer or pq.ParquetWriter(sink, batch.schema)
                writer.write_batch(batch)
        if writer:
            writer.close()
    filesystem.move(part, f"{inner}/{name}")
    return name, 1, sink.size, rows, sink.digest.hexdigest()


def move_files(folder, target, stem, suffix, replace):
    """Body of ``mapInArrow``: move the shard file of every number to its place; done ones are left."""

    def move(batches):
        import pyarrow as pa
        from pyarrow import fs

        filesystem, source = open_filesystem(folder)
        base = open_filesystem(target)[1]
        for batch in batches:
            for shard in batch["id"].to_pylist():
                name = f"{stem}.shard{shard:04d}{suffix}"
                here, there = filesystem.get_file_info([f"{source}/{name}", f"{base}/{name}"])
                missing = here.type == fs.FileType.NotFound
                if missing and there.type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{source}/{name}")
                if not missing:
                    if there.type != fs.FileType.NotFound and not replace:
                        raise FileExistsError(f"{base}/{name} cannot be written")
                    filesystem.move(f"{source}/{name}", f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"moved": batch["id"]})

    return move


def entries_of(filesystem, directory, batch=4096):
    """(name, is file, is directory, size, modified) of a directory, a bounded batch at a time.

    Links to directories are not followed.  A store's client gives its listing as a whole.
    """
    import datetime
    import os

    from pyarrow import fs

    if not isinstance(filesystem, fs.LocalFileSystem):
        infos = filesystem.get_file_info(fs.FileSelector(directory))
        for at in range(0, len(infos), batch):
            yield [(i.base_name, i.is_file, i.type == fs.FileType.Directory, i.size, i.mtime) for i in infos[at : at + batch]]
        return
    found = []
    with os.scandir(directory) as entries:
        for entry in entries:
            if entry.is_file():
                facts = entry.stat()
                found.append((entry.name, True, False, facts.st_size, datetime.datetime.fromtimestamp(facts.st_mtime, datetime.timezone.utc)))
            elif entry.is_dir(follow_symlinks=False):
                found.append((entry.name, False, True, 0, None))
            if len(found) == batch:
                yield found
                found = []
    if found:
        yield found


def tree_walker(base, budget, regexes=(), recursive=True):
    """Body of ``mapInArrow``: directories in, files below them out, one round of a walk.

    Input column ``rel_path``.  Output: kind "file" (with length, modified), "opened" (a directory
    that was listed) or "left" (one still to be listed: a task opens about ``budget`` directories,
    so that a lopsided tree is dealt out anew).  A directory whose path or name fits one of
    ``regexes`` is never opened.
    """

    def walk(batches):
        import pyarrow as pa

        schema = pa.schema([("kind", pa.string()), ("path", pa.string()), ("rel_path", pa.string()), ("length", pa.int64()),
                            ("modified", pa.timestamp("us", "UTC"))])
        one = re.compile("|".join(f"(?:{r})" for r in regexes), re.DOTALL) if regexes else None
        filesystem, root = open_filesystem(base)
        root = root.rstrip("/")

        def out(kind, rows):
            columns = [[kind] * len(rows), [f"{base}/{r[0]}" for r in rows], [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        left = budget
        for batch in batches:
            waiting = batch["rel_path"].to_pylist()
            while waiting and left > 0:
                rel = waiting.pop()
                left -= 1
                yield out("opened", [(rel, None, None)])
                lead = f"{rel}/" if rel else ""
                for entries in entries_of(filesystem, f"{root}/{rel}".rstrip("/") or "/"):
                    files = [(lead + name, size, modified) for name, is_file, _, size, modified in entries if is_file]
                    if files:
                        yield out("file", files)
                    if recursive:
                        below = [(lead + name, name) for name, _, is_directory, _, _ in entries if is_directory]
                        waiting += [path for path, name in below if one is None or not (one.match(path) or one.match(name))]
            if waiting:
                yield out("left", [(rel, None, None) for rel in waiting])

    return walk


def file_worker(fn, names, side_name, record, again=None):
    """Body of ``mapInPandas`` for ``map_raw_files``: (shard_id, path) in, what ``fn`` makes of each file out.

    ``again``: (shard, number of its first attempt) of those that run again.
    """
    firsts = dict(again or ())

    def work(batches):
        import io

        import pandas as pd
        import pyarrow as pa
        from pyspark import TaskContext

        class Stream(io.BufferedReader):
            """A binary file; ``path`` says which."""

            path = ""

        context = TaskContext.get()
        extra = (side_path(side_name),) if side_name else ()

        def as_frame(out, shard_id):
            frame = out.to_pandas() if isinstance(out, (pa.RecordBatch, pa.Table)) else out
            frame = frame[names].copy()
            frame.insert(0, "shard_id", shard_id)
            if record:
                frame = frame.assign(_rowloom_attempt=None, _rowloom_status=None, _rowloom_error=None, _rowloom_rows_out=None)
            return frame

        for frame in batches:
            for shard_id, path in zip(frame["shard_id"], frame["path"]):
                rows_out, error = 0, None
                attempt = firsts.get(int(shard_id), 0) + context.attemptNumber()
                announce(attempt)
                try:
                    filesystem, inner = open_filesystem(path)
                    with filesystem.open_input_file(inner) as raw, Stream(raw, 1 << 20) as stream:
                        stream.path = path
                        for out in fn(int(shard_id), stream, *extra):
                            made = as_frame(out, int(shard_id))
                            rows_out += len(made)
                            yield made
                except Exception as exc:
                    if not record:
                        raise
                    error = f"{type(exc).__name__}: {exc}"
                if record:
                    outcome = {name: [None] for name in names}
                    outcome.update(shard_id=[int(shard_id)], _rowloom_attempt=[attempt], _rowloom_error=[error],
                                   _rowloom_status=["failed" if error else "ok"], _rowloom_rows_out=[rows_out])
                    yield pd.DataFrame(outcome)

    return work
