"""Papers of JSON documents and DOIs of BibTeX files of any size, a file read by as many tasks as it has blocks.

Spark's text source cuts a file at every ``}``, so tasks get whole fragments on
any file system. Two passes find the entries:

1. Each block sums up what it does to the state of a reader, as a function of
   the state it begins with, which nobody knows yet: for JSON whether a text is
   open and how deep brackets nest, for BibTeX whether and how deep an entry is
   open. The functions are composed in the order of the blocks on the driver
   (one row a block).
2. With its state known, each block cuts its entries exactly. One that runs on
   into other blocks comes in pieces, which are put together by the block in
   which it begins.

Both passes must see the same blocks; where a change of the cluster between them
has moved the blocks, the reading starts anew.

Defined cases: several files are read in order of their names; a document that
is no JSON raises ValueError; a BibTeX file with an entry or value that never
ends gives the DOIs by their form; empty files give no rows.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.doi import extract_dois
from quire.schema import PAPER_DDL, canonical
from quire.sources.doi_lists import bib_entries
from quire.tables import counted, materialise, number_rows, running_total

#: Where files are cut.
CUT = b"}"
#: Bytes of a block: a reader has about fifty bytes of numbers for each of its bytes.
WINDOW = 1 << 21
_MOVED = "the blocks of the input have moved"
#: Kinds of BibTeX blocks that are no entries.
_NO_ENTRIES = ("comment", "preamble", "string")
_ENTRY = re.compile(rb"@\s*(\w+)\s*([{(])")


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", CUT.decode()).text(path)
    m = "_metadata."
    return text.select(F.col(m + "file_path").alias("file"), F.col(m + "file_block_start").alias("block"), F.col(m + "file_size").alias("size"), "value")


def _blocks(batches) -> Iterator[tuple[str, int, int, Iterator[bytes]]]:
    """(file, block, size of the file, its stretches of text) of a task's blocks, in order of reading.

    A block of the file system is cut into blocks of ``WINDOW`` bytes, or one
    fragment more, so that a task holds no more of it; they are numbered by the
    bytes read of it, which both passes count alike.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def stretches():
        whole, at, left = None, 0, 0  # the block of the file system, where the one at hand begins, bytes that it still takes
        for batch in batches:
            files, starts, sizes = (batch.column(i).to_pylist() for i in range(3))
            values = batch.column(3).cast(pa.binary())
            ends = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64) + len(CUT))
            lo = 0
            while lo < len(files):
                if (files[lo], starts[lo]) != whole:
                    whole, at, left = (files[lo], starts[lo]), starts[lo], WINDOW
                elif left <= 0:
                    at, left = at + WINDOW - left, WINDOW
                read = int(ends[lo - 1]) if lo else 0
                # up to the fragment with which the window is full
                hi = min(int(np.searchsorted(ends, read + left)) + 1, len(files))
                hi = next((i for i in range(lo + 1, hi) if (files[i], starts[i]) != whole), hi)
                left -= int(ends[hi - 1]) - read
                yield files[lo], at, sizes[lo], CUT.join(values.slice(lo, hi - lo).to_pylist()) + CUT
                lo = hi

    held = None
    rest = stretches()
    first = next(rest, None)

    def own(key):
        nonlocal held
        while held is not None and held[:2] == key:
            yield held[3]
            held = next(rest, None)

    held = first
    while held is not None:
        key, size = held[:2], held[2]
        parts = own(key)
        yield *key, size, parts
        # what was not asked for
        for _ in parts:
            pass


# ----- JSON -----


def _marks(text: bytes, parity: int):
    """Bytes as an array with escaped ones blanked, and for each byte whether it stands in a text (which began so if ``parity``)."""
    import numpy as np

    plain = re.sub(rb"\\.", b"  ", text, flags=re.S) if b"\\" in text else text
    x = np.frombuffer(plain, np.uint8)
    quotes = x == 34
    after = (np.cumsum(quotes) + parity) & 1
    # an opening quote and a closing one belong to the text
    return x, (after == 1) | quotes, int(after[-1]) if len(x) else parity


def _steps(x, inside):
    """+1 and -1 where brackets open and close outside of texts."""
    import numpy as np

    out = np.zeros(len(x), np.int64)
    out[((x == 91) | (x == 123)) & ~inside] = 1
    out[((x == 93) | (x == 125)) & ~inside] = -1
    return out


def json_effect(parts) -> dict:
    """What a block does: bytes, whether it flips "in a text", the change of depth if it begins outside or inside of one, its first character."""
    size = flips = 0
    deltas, first = [0, 0], ""
    for text in parts:
        size += len(text)
        if not first and (bare := text.strip()):
            first = chr(bare[0])
        x, inside, parity = _marks(text, flips)
        deltas[0] += int(_steps(x, inside).sum())
        _, other, _ = _marks(text, flips ^ 1)
        deltas[1] += int(_steps(x, other).sum())
        flips = parity
    return {"bytes": size, "flips": flips, "deltas": deltas, "first": first}


def compose_json(effects: list[tuple[str, int, int, dict]]) -> dict[tuple[str, int], dict]:
    """The state in which each block begins; raises ValueError for a document that does not end well."""
    out: dict[tuple[str, int], dict] = {}
    by_file: dict[str, list] = {}
    for file, block, size, effect in sorted(effects, key=lambda e: e[:2]):
        by_file.setdefault(file, []).append((block, size, effect))
    for file, blocks in by_file.items():
        extra = sum(e["bytes"] for _, _, e in blocks) - blocks[0][1]
        first = next((e["first"] for _, _, e in blocks if e["first"]), "")
        depth = inside = 0
        for block, _, e in blocks:
            out[file, block] = {"depth": depth, "inside": inside, "list": first == "[", "extra": 0}
            depth, inside = depth + e["deltas"][inside], inside ^ e["flips"]
        # the cut that follows the last fragment is there only if the file ends with it
        out[file, blocks[-1][0]]["extra"] = extra
        if extra and not inside:
            depth += 1
        if first not in ("[", "{") or depth or inside:
            raise ValueError(f"{file} is not valid JSON")
    return out


class _JsonEntries:
    """Cuts the elements of the document's list, or of the lists that are values of its keys.

    Rows are (kind, key, text); kind is ``list`` where a list begins, ``whole``
    for an element, ``head``, ``middle`` and ``tail`` for pieces of one, ``name``,
    ``more`` and ``named`` for the pieces of what may be a key: at the end of a
    block, all of it, and at its begin. The
    key is None where it was named in an earlier block.
    """

    def __init__(self, state: dict):
        self.at = 1 if state["list"] else 2
        self.depth, self.parity = state["depth"], state["inside"]
        # within a list or not: unknown (None) where that began earlier
        self.listed: bool | None = True if state["list"] else None if self.depth >= 2 else False
        self.key: str | None = "" if state["list"] else None
        self.open = self.depth >= self.at
        self.held: list[bytes] = []
        self.begun = False
        #: what may be a key, and whether it began in an earlier block
        self.name, self.partial = b"", self.at == 2 and self.depth == 1 and bool(self.parity)
        self.moved = False

    def feed(self, text: bytes) -> list[tuple[str, str | None, str]]:
        import numpy as np

        rows: list[tuple[str, str | None, str]] = []
        x, inside, self.parity = _marks(text, self.parity)
        steps = _steps(x, inside)
        depth = self.depth + np.cumsum(steps)
        before = depth - steps
        edge = ((before == self.at) | (depth == self.at)) & (steps != 0) & ((before < self.at) | (depth < self.at))
        edge |= (x == 44) & ~inside & (depth == self.at)
        if self.at == 2:
            edge |= ((x == 44) | (x == 58)) & ~inside & (depth == 1)
        last = 0
        self.moved |= bool(edge.any())
        for i in np.flatnonzero(edge).tolist():
            piece, c = text[last:i], text[i]
            last = i + 1
            if c == 58:  # a key has ended
                self.name += piece
                if self.partial:
                    rows.append(("named", None, self.name.decode("utf-8", "replace")))
                    self.key = None
                else:
                    self.key = json.loads(self.name.lstrip(b" \t\r\n{"))
                self.name, self.partial = b"", False
            elif c == 44 and depth[i] < self.at:
                self.name, self.partial = b"", False
            elif steps[i] == 1:
                self.open, self.listed, self.begun, self.held = True, c == 91, True, []
                if self.listed:
                    rows.append(("list", self.key, ""))
            else:
                self.held.append(piece)
                rows += self._close()
                self.open, self.begun = steps[i] == 0, True
                if steps[i] == -1:
                    self.name = b""
        rest = text[last:]
        if self.open:
            self.held.append(rest)
        else:
            self.name += rest
        if len(depth):
            self.depth = int(depth[-1])
        return rows

    def _close(self) -> list[tuple[str, str | None, str]]:
        text = b"".join(self.held).decode("utf-8", "replace")
        self.held = []
        if self.listed is False:
            return []
        if not self.begun:
            return [("tail", None, text)]
        return [("whole", self.key, text)] if text.strip() else []

    def end(self) -> list[tuple[str, str | None, str]]:
        """What is left when the block is over; an element may begin with the next block, so its piece can be empty."""
        if not self.open and self.at == 2 and self.depth == 1 and self.parity:
            return [("name" if self.moved or not self.partial else "more", None, self.name.decode("utf-8", "replace"))]
        if not self.open or self.listed is False:
            return []
        return [("head" if self.begun else "middle", self.key if self.begun else None, b"".join(self.held).decode("utf-8", "replace"))]


# ----- BibTeX -----


def bib_effect(parts) -> dict:
    """What a block does to each state: nothing open, or an entry open at depth d in braces or brackets.

    ``out`` is the state after beginning outside; for either bracket ``ways``
    has the state after each d that the block closes, and ``total`` the change of
    depth for deeper ones.
    """
    text = b"".join(parts)
    ends = _BibBlock(text)
    return {"bytes": len(text), "out": ends.after(0), "ways": {b: [ends.after(i + 1) for i in ends.closes[b]] for b in "{("}, "total": {b: ends.total[b] for b in "{("}}


class _BibBlock:
    def __init__(self, text: bytes):
        import numpy as np

        x = np.frombuffer(text, np.uint8)
        self.text, self.level, self.total, self.closes, self._places = text, {}, {}, {}, {}
        for b, (o, c) in {"{": (123, 125), "(": (40, 41)}.items():
            level = np.cumsum((x == o).astype(np.int64) - (x == c))
            self.level[b], self.total[b] = level, int(level[-1]) if len(level) else 0
            # where an entry of depth 1, 2, ... that was open before closes
            lows = np.minimum.accumulate(level) if len(level) else level
            self.closes[b] = [int(np.searchsorted(-lows, d)) for d in range(1, -int(lows[-1]) + 1)] if len(lows) and lows[-1] < 0 else []
            downs = np.flatnonzero(x == c)
            order = np.lexsort((downs, level[downs]))
            self._places[b] = level[downs][order], downs[order]
        self.starts = [(m.start(), m.end(), m[2].decode()) for m in _ENTRY.finditer(text) if m[1].decode("utf-8", "replace").lower() not in _NO_ENTRIES]
        self.at = [s for s, _, _ in self.starts]
        #: by start: where its entry closes, None if not in this block
        self.stops = [self._close(end - 1, b) for _, end, b in self.starts]
        self._after: list[list] | None = None

    def _close(self, bracket: int, b: str) -> int | None:
        levels, places = self._places[b]
        target = int(self.level[b][bracket]) - 1
        import numpy as np

        lo, hi = np.searchsorted(levels, target, "left"), np.searchsorted(levels, target, "right")
        k = lo + int(np.searchsorted(places[lo:hi], bracket))
        return int(places[k]) if k < hi else None

    def entries(self, position: int) -> Iterator[tuple[int, int | None, str, int]]:
        """(start, stop, bracket, depth left open) of entries from a position outside of any."""
        k = bisect_left(self.at, position)
        while k < len(self.starts):
            start, end, b = self.starts[k]
            stop = self.stops[k]
            yield start, stop, b, 0 if stop is not None else int(self.total[b] - self.level[b][end - 1]) + 1
            if stop is None:
                return
            k = bisect_right(self.at, stop)

    def after(self, position: int) -> list:
        """The state at the end of the block, having been outside of any entry at ``position``; worked out once for each entry, from the last one on."""
        if self._after is None:
            self._after = [[]] * (len(self.starts) + 1)
            for k in reversed(range(len(self.starts))):
                _, end, b = self.starts[k]
                stop = self.stops[k]
                self._after[k] = [b, int(self.total[b] - self.level[b][end - 1]) + 1] if stop is None else self._after[bisect_right(self.at, stop)]
        return self._after[bisect_left(self.at, position)]


def _next_state(effect: dict, state: list) -> list:
    if not state:
        return effect["out"]
    bracket, depth = state
    ways = effect["ways"][bracket]
    return ways[depth - 1] if depth <= len(ways) else [bracket, depth + effect["total"][bracket]]


def compose_bib(effects: list[tuple[str, int, int, dict]]) -> dict[tuple[str, int], dict]:
    """The state in which each block begins; ``sound`` is false for all blocks of a file whose last entry never ends."""
    out: dict[tuple[str, int], dict] = {}
    by_file: dict[str, list] = {}
    for file, block, size, effect in sorted(effects, key=lambda e: e[:2]):
        by_file.setdefault(file, []).append((block, size, effect))
    for file, blocks in by_file.items():
        extra = sum(e["bytes"] for _, _, e in blocks) - blocks[0][1]
        state: list = []
        for block, _, e in blocks:
            out[file, block] = {"state": state, "extra": 0, "sound": True}
            before, state = state, _next_state(e, state)
        out[file, blocks[-1][0]]["extra"] = extra
        if extra:
            # the last fragment has no cut behind it: an entry that it closed is open
            out[file, blocks[-1][0]]["recheck"] = before
    return out


class _BibEntries:
    """Cuts the entries of a block; the block, of ``WINDOW`` bytes or one fragment more, is held whole."""

    def __init__(self, state: dict):
        self.state, self.parts = state["state"], []

    def feed(self, text: bytes) -> list:
        self.parts.append(text)
        return []

    def end(self) -> list[tuple[str, str | None, str]]:
        text, rows, at = b"".join(self.parts), [], 0
        block = _BibBlock(text)
        said = lambda lo, hi: text[lo:hi].decode("utf-8", "replace")
        if self.state:
            bracket, depth = self.state
            if depth > len(block.closes[bracket]):
                return [("middle", None, said(0, len(text)))]
            at = block.closes[bracket][depth - 1] + 1
            rows.append(("tail", None, said(0, at)))
        for start, stop, _, _ in block.entries(at):
            rows.append(("head", "", said(start, len(text))) if stop is None else ("whole", "", said(start, stop + 1)))
        return rows


# ----- both -----


def _read(spark: SparkSession, path: str, effect: Callable, compose: Callable, cutter: type) -> DataFrame:
    """Entries of pieces that are written out: file, block (in which an entry begins), n (its number there), run and place (the run of entries of one key there, and its number in it), key, lists (whether the row says that a list begins), text."""
    for attempt in range(3):
        states = _states(spark, path, effect, compose)
        try:
            return _joined(materialise(_pieces(spark, path, states, cutter), "pieces"))
        except PythonException as e:
            if _MOVED not in str(e) or attempt == 2:
                raise
    raise AssertionError("unreachable")


def _states(spark: SparkSession, path: str, effect: Callable, compose: Callable) -> dict[tuple[str, int], dict]:
    def sum_up(batches):
        import pyarrow as pa

        for file, block, size, parts in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([size], pa.int64()), pa.array([json.dumps(effect(parts))])], names=["file", "block", "size", "effect"])

    found = _fragments(spark, path).mapInArrow(sum_up, "file string, block long, size long, effect string")
    # one row a block
    return compose([(r["file"], r["block"], r["size"], json.loads(r["effect"])) for r in found.collect()])


def _pieces(spark: SparkSession, path: str, states: dict, cutter: type) -> DataFrame:
    def cut(batches):
        import pyarrow as pa

        for file, block, _, parts in _blocks(batches):
            if (file, block) not in states:
                raise RuntimeError(_MOVED)
            state = states[file, block]
            reader, at, ahead = cutter(state), _Places(), None
            for text in parts:
                if ahead is not None:
                    rows = reader.feed(ahead)
                    if rows:
                        yield table(file, block, at, rows, pa)
                ahead = text
            if ahead is not None:
                rows = reader.feed(ahead[:-1] if state["extra"] else ahead) + reader.end()
                if rows:
                    yield table(file, block, at, rows, pa)

    def table(file, block, at, rows, pa):
        kinds, keys, texts = zip(*rows, strict=True)
        numbers = (pa.array(x, pa.int64()) for x in zip(*(at.of(kind, key) for kind, key in zip(kinds, keys, strict=True)), strict=True))
        return pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array([block] * len(rows), pa.int64()), *numbers, pa.array(kinds), pa.array(keys, pa.string()), pa.array(texts, pa.string())], names=["file", "block", "n", "run", "place", "kind", "key", "text"])

    return _fragments(spark, path).mapInArrow(cut, "file string, block long, n long, run long, place long, kind string, key string, text string")


class _Places:
    """Numbers the rows of a block, and the entries that begin in it within each run of one key; pieces of earlier entries have no place."""

    def __init__(self):
        self.n, self.run, self.place, self.key = 0, 0, 0, None

    def of(self, kind: str, key: str | None) -> tuple[int, int | None, int | None]:
        n, self.n = self.n, self.n + 1
        if kind == "list" or (kind in ("whole", "head") and key != self.key):
            self.run, self.place, self.key = self.run + 1, 0, key
        if kind not in ("whole", "head"):
            return n, None, None
        self.place += 1
        return n, self.run, self.place


def _joined(pieces: DataFrame) -> DataFrame:
    """Pieces to entries; what began in an earlier block goes by the block of its head."""
    spark = pieces.sparkSession
    # two rows a block: the last key, and the entry left open
    text_of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("text")))
    ends = pieces.where("kind IN ('head', 'middle', 'tail', 'name', 'more', 'named') OR key IS NOT NULL").groupBy("file", "block").agg(F.max(F.when(F.col("key").isNotNull(), F.struct("n", "key"))).alias("k"), F.max(F.when(F.col("kind") == "head", F.col("n"))).alias("head"), F.bool_or(F.col("kind") == "middle").alias("through"), text_of("name").alias("name"), text_of("more").alias("more"), text_of("named").alias("named")).collect()
    begun, file, key, head, name = [], None, None, None, ""
    for r in sorted(ends, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, key, head, name = r["file"], None, None, ""
        if r["named"] is not None:
            key = json.loads((name + r["named"]).lstrip(" \t\r\n{"))
        begun.append((file, r["block"], head[0] if head else None, head[1] if head else None, key))
        key = r["k"]["key"] if r["k"] else key
        name = name + r["more"] if r["more"] is not None else r["name"] or ""
        head = (r["block"], r["head"]) if r["head"] is not None else head if r["through"] else None
    table = F.broadcast(spark.createDataFrame(begun, "file string, block long, _hb long, _hn long, _key string"))
    placed = pieces.join(table, ["file", "block"], "left")
    late = F.col("kind").isin("middle", "tail")
    own = placed.select("file", F.when(late, F.col("_hb")).otherwise(F.col("block")).alias("block"), F.when(late, F.col("_hn")).otherwise(F.col("n")).alias("n"), "run", "place", F.col("block").alias("_part"), "kind", F.when(late, F.lit(None).cast("string")).otherwise(F.coalesce("key", "_key")).alias("key"), "text")
    done = own.where("kind IN ('whole', 'list')").select("file", "block", "n", "run", "place", "key", (F.col("kind") == "list").alias("lists"), "text")
    # an entry that runs over several blocks
    split = own.where("kind IN ('head', 'middle', 'tail') AND block IS NOT NULL").groupBy("file", "block", "n").agg(F.max("run").alias("run"), F.max("place").alias("place"), F.max("key").alias("key"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_part", "text"))), lambda p: p["text"]), "").alias("text"))
    return done.unionByName(split.where(F.trim("text") != "").select("file", "block", "n", "run", "place", "key", F.lit(False).alias("lists"), "text"))


def read_papers_files(spark: SparkSession, path: str) -> DataFrame:
    """Papers of JSON files as ``documents.read_papers`` has them, whatever a file's size; ``_pos`` runs on from file to file."""
    entries = _read(spark, path, json_effect, compose_json, _JsonEntries)
    lists = entries.where("lists").groupBy("file").agg(F.max(F.col("key") == "results").alias("_results"), F.max(F.col("key") == "kept").alias("_kept"))
    # entries are placed by their runs, of which a block has few: no text is moved to number them
    runs = entries.where("NOT lists").groupBy("file", "block", "run").agg(F.max("key").alias("key"), F.max("place").alias("_m")).join(lists, "file", "left")
    wanted = F.when(F.col("_results"), F.col("key") == "results").when(F.col("_kept"), F.col("key") == "kept").otherwise(True)
    chosen = runs.where(F.coalesce(wanted, F.lit(True))).select(F.struct("file", "block", "run").alias("_pos"), "_m")
    bases = counted(running_total(chosen, "_m", "_n").select("_pos.*", (F.col("_n") - F.col("_m")).alias("_base")), "runs")
    placed = entries.where("NOT lists").join(bases, ["file", "block", "run"])
    read = placed.select((F.col("_base") + F.col("place") - 1).cast("bigint").alias("_pos"), F.from_json(F.to_json(F.parse_json("text")), PAPER_DDL).alias("p"))
    return canonical(read.select("_pos", "p.*"))


def read_bib_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, _pos, doi): the DOIs of BibTeX files in order, the first of each in its file (letter case aside)."""
    import pandas as pd

    entries = materialise(_read(spark, path, bib_effect, compose_bib, _BibEntries), "entries")

    def doi_of(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str | None:
            try:
                found = bib_entries(text)
            except ValueError:
                return None
            return found[0].get("doi", "") if found else ""

        return texts.map(one)

    doi_of.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    read = materialise(entries.select("file", "block", "n", F.pandas_udf(doi_of, "string")("text").alias("doi")), "dois")
    # a file with an entry that cannot be read is read by the form of a DOI; DOIs hold no brace, so fragments have them whole
    broken = read.where("doi IS NULL").select("file").distinct()
    formed = _fragments(spark, path).join(F.broadcast(broken) if broken.count() <= 10_000 else broken, "file", "left_semi").select("file", "block", F.monotonically_increasing_id().alias("n"), F.posexplode(extract_dois(F.col("value"))).alias("at", "doi"))
    sound = read.join(broken, "file", "left_anti").where("doi <> ''").select("file", "block", "n", F.lit(0).alias("at"), "doi")
    first = sound.unionByName(formed).groupBy("file", F.lower("doi").alias("k")).agg(F.min_by("doi", F.struct("block", "n", "at")).alias("doi"), F.min(F.struct("block", "n", "at")).alias("p"))
    numbered = number_rows(first.select(F.struct("file", "p").alias("_pos"), "doi"))
    return numbered.select("_pos.file", (F.col("_n") - 1).cast("bigint").alias("_pos"), "doi")
