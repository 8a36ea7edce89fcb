"""Alignment of the tokens of two tokenizers by byte offsets, and how often their tokens go together.

Both tokenizers' token ends are offsets in the same bytes. Divide and conquer at shared cuts: near the middle token of
an interval a common end is located by bisecting the other side's ends, and both halves go on alike; an interval
without a common end inside is a group, whose tokens are all linked with each other.

The top of the recursion is known without looking: before white space that follows other text both tokenizers always
cut (the byte-level one by its pattern; the piece model where no piece holds such a character after another, which is
read off its vocabulary). Texts are cut into units there, and each distinct unit of a block of texts is encoded,
verified and aligned once. Texts are then lists of units.

How many documents hold an id pair linked is counted in each block first, and summed by pair. A block asks only for its
own pairs' counts, as a join, and adds them up over its documents: pairs of single documents are never shuffled.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidepool.llm.shared import table, written

_CUT = "\ud800"  # no text in a table holds a lone surrogate
_MARK = "▁"


def shared_groups(a: np.ndarray, b: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups of two ascending arrays of ends stop: numbers of tokens of a and of b up to there.

    cuts are ends that both are known to have, the last one at least. The intervals between them are divided side by
    side: each looks for a common end, from its middle token of a outwards, one step a round.
    """
    cuts = a[-1:] if cuts is None else cuts
    j, m = np.searchsorted(a, cuts) + 1, np.searchsorted(b, cuts) + 1
    i, k, step = np.append(0, j[:-1]), np.append(0, m[:-1]), np.zeros(len(cuts), np.int64)
    done = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    while len(i):
        leaf = (step >= j - i) | (j - i < 2) | (m - k < 2)
        done.append((j[leaf], m[leaf]))
        i, j, k, m, step = (x[~leaf] for x in (i, j, k, m, step))
        at = (i + j - 2) // 2 + (step + 1) // 2 * np.where(step % 2, 1, -1)
        inside = (at >= i) & (at < j - 1)
        at = np.where(inside, at, i)
        there = np.searchsorted(b, a[at])
        hit = inside & (b[there] == a[at])
        miss, x, y = ~hit, at[hit] + 1, there[hit] + 1
        i, j, k, m = (np.concatenate(c) for c in ((i[miss], i[hit], x), (j[miss], x, j[hit]), (k[miss], k[hit], y), (m[miss], y, m[hit])))
        step = np.append(step[miss] + 1, np.zeros(2 * len(x), np.int64))
    j, m = (np.concatenate(c) for c in zip(*done))
    order = np.argsort(j)
    return j[order], m[order]


class Tokenizers:
    """Both tokenizers, and their tokens' lengths and bytes."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(x): x for x in shown} | {chr(0x100 + i): x for i, x in enumerate(sorted(set(range(256)) - set(shown)))}
        tokens = {i: t for t, i in self.a.get_vocab().items()}
        self.a_bytes = [bytes(byte.get(c, 0x3F) for c in tokens.get(i, "")) for i in range(1 + max(tokens))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        names = [f"{i}{after}" for n, last in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";")) for i in range(n) for after in (",", last)]
        self.names = pa.array(names, pa.binary())
        plain = [p for i, p in enumerate(pieces) if not self.b.is_byte(i) and not self.b.is_control(i)]
        inside = {c for p in plain for c in p.lstrip(p[:1])}
        self.spaced = _MARK not in inside
        self.lined = self.spaced and not any("\n" in p for p in plain)

    def units(self, text: str) -> list[str]:
        """text, with a space before it, cut before white space that follows other text."""
        whole = " " + text
        if not self.spaced:
            return [whole]
        marked = whole.replace(" ", _CUT + " ")
        if self.lined:
            marked = marked.replace("\n", _CUT + "\n")
        return marked.split(_CUT)[1:]

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of units one after another, of either side."""
        whole = "".join(units)
        a = self.a.encode_batch_fast([whole], add_special_tokens=False)[0].ids
        # a new line never merges: after one, the model's own space is out of the way
        b = self.b.encode("\n" + whole)[2:] if self.lined else self.b.encode(whole[1:])
        return np.array(a, np.int64), np.array(b, np.int64)

    def shown(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, bytes, np.ndarray]:
        """Groups as a1,a2|b1; one after another: of each token where its text stops, and the text; the tokens of group after group up to each end."""
        many = len(a) + len(b)
        place = np.empty(many, np.int64)
        group_a, group_b = np.repeat(np.arange(len(a_ends)), np.diff(a_ends, prepend=0)), np.repeat(np.arange(len(b_ends)), np.diff(b_ends, prepend=0))
        place[np.arange(len(a)) + np.append(0, b_ends)[group_a]] = 2 * a
        place[np.arange(len(b)) + a_ends[group_b]] = 2 * (b + len(self.a_bytes))
        place[a_ends + np.append(0, b_ends[:-1]) - 1] += 1
        place[a_ends + b_ends - 1] += 1
        text = self.names.take(pa.array(place))
        return np.frombuffer(text.buffers()[1], np.int32)[1 : many + 1], text.buffers()[2].to_pybytes() if many else b"", a_ends + b_ends


@lru_cache(maxsize=1)
def tokenizers(byte_path: str, piece_path: str) -> Tokenizers:
    return Tokenizers(byte_path, piece_path)


class Units:
    """The distinct units of a block: whether both sides spell each, its tokens of a and of b, groups, links, text of its groups."""

    def __init__(self, coder: Tokenizers):
        self.coder, self.number = coder, {}
        self.open: set[str] = set()  # units that end in white space
        self.known: list[np.ndarray] = []
        self.shown: list[bytes] = []
        self.pairs: list[np.ndarray] = []  # links as a << 32 | b, unit after unit

    def learn(self, units: list[str]) -> None:
        open_ = [u for u in units if u[-1].isspace()]
        self.open.update(open_)
        plain = [u for u in units if u not in self.open]
        step = 2000 if self.coder.spaced else 1
        for part in [*(plain[i : i + step] for i in range(0, len(plain), step)), *([u] for u in open_)]:
            self._learn(part)

    def _learn(self, units: list[str]) -> None:
        coder, raw = self.coder, [u.encode() for u in units]
        a, b = coder.encode(units)
        whole = b"".join(raw)
        spelled = all(b"".join(map(of.__getitem__, x.tolist())) == whole for of, x in ((coder.a_bytes, a), (coder.b_bytes, b)))
        if not spelled and len(units) > 1:  # some unit is to blame
            self._learn(units[: len(units) // 2])
            self._learn(units[len(units) // 2 :])
            return
        self.number.update(zip(units, range(len(self.number), len(self.number) + len(units))))
        if not spelled:
            self.known.append(np.zeros((1, 5), np.int64))
            self.shown.append(b"")
            return
        ends = np.cumsum([*map(len, raw)])
        x, y = np.cumsum(coder.a_size[a]), np.cumsum(coder.b_size[b])
        a_ends, b_ends = shared_groups(x, y, ends)
        n_a, n_b = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
        last = np.searchsorted(x[a_ends - 1], ends) + 1  # groups up to the end of each unit
        n = n_a * n_b
        links = np.append(0, np.cumsum(n))
        inside = np.arange(links[-1]) - np.repeat(links[:-1], n)
        left = a[np.repeat(a_ends - n_a, n) + inside // np.repeat(n_b, n)]
        self.pairs.append(left << 32 | b[np.repeat(b_ends - n_b, n) + inside % np.repeat(n_b, n)])
        counts = [np.diff(c, prepend=0) for c in (a_ends[last - 1], b_ends[last - 1], last, links[last])]
        self.known.append(np.stack([np.ones(len(units), np.int64), *counts], 1))
        stops, text, tokens = coder.shown(a, b, a_ends, b_ends)
        stops = stops[tokens[last - 1] - 1].tolist()
        self.shown += [text[i:j] for i, j in zip([0, *stops], stops)]


def _joined(units: list[str]) -> list[str]:
    """Units merged where one ends in white space: there is no cut of both after it."""
    out = [units[0]]
    for u in units[1:]:
        if out[-1][-1].isspace():
            out[-1] += u
        else:
            out.append(u)
    return out


class _Block:
    """Texts taken in one after another, then described together."""

    def __init__(self, coder: Tokenizers):
        self.coder, self.units, self.texts, self.size = coder, Units(coder), [], 0

    def add(self, texts: list[str | None]) -> None:
        number = self.units.number
        cut, fresh = [], {}
        for t in texts:
            own = self.coder.units(t) if t else []
            new = [u for u in own if u not in number]
            if any(u[-1].isspace() for u in new) or not self.units.open.isdisjoint(own[:-1]):
                own = _joined(own)
                new = [u for u in own if u not in number]
            cut.append(own)
            fresh.update(dict.fromkeys(new))
        if fresh:
            self.units.learn(list(fresh))
        self.texts += [np.fromiter(map(number.__getitem__, own), np.int32, len(own)) for own in cut]
        self.size += sum(map(len, (t for t in texts if t)))

    def described(self) -> tuple[list[tuple], list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
        """For each text: (n_a, n_b, n_groups, n_links, digest), its distinct pairs' numbers, how often it links each;
        the block's pairs and how many of its texts hold each.
        """
        u = self.units
        known = np.concatenate([np.empty((0, 5), np.int64), *u.known])
        links, flat = known[:, 4], np.concatenate([np.empty(0, np.int64), *u.pairs])
        first = np.cumsum(links) - links
        pairs, place = np.unique(flat, return_inverse=True)
        rows, numbers, times = [], [], []
        holds = np.zeros(len(pairs), np.int64)
        for own in self.texts:
            if not len(own) or not known[own, 0].all():
                rows.append((0, 0, 0, 0, ""))
                numbers.append(np.empty(0, np.int32))
                times.append(np.empty(0, np.int32))
                continue
            n = links[own]
            until = np.cumsum(n)
            mine = place[np.arange(until[-1]) + np.repeat(first[own] - until + n, n)]
            distinct, often = np.unique(mine, return_counts=True)
            holds[distinct] += 1
            digest = hashlib.sha256(b"".join([u.shown[i] for i in own.tolist()])[:-1]).hexdigest()
            rows.append((*known[own, 1:].sum(0).tolist(), digest))
            numbers.append(distinct.astype(np.int32))
            times.append(often.astype(np.int32))
        return rows, numbers, times, pairs, holds


def aligned_blocks(docs: DataFrame, byte_path: str, piece_path: str, keep: list[str], text: str = "text", block_chars: int = 6 << 20) -> DataFrame:
    """keep, block, n_a, n_b, n_groups, n_links, groups_sha256, numbers and times of each document's pairs; and one row
    for each block, keep null, with its pairs and how many of its documents hold each (holds).
    """
    added = StructType.fromDDL("block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, numbers array<int>, times array<int>, "
                               "pairs array<long>, holds array<long>")
    schema = StructType([docs.schema[k] for k in keep] + added.fields)

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, coder = to_arrow_schema(schema), tokenizers(byte_path, piece_path)
        number, block, held = TaskContext.get().partitionId() << 32, _Block(coder), []

        def out():
            nonlocal number, block, held
            rows, numbers, times, pairs, holds = block.described()
            own = pa.Table.from_batches(held).combine_chunks()
            columns = [own.column(i).combine_chunks().cast(f.type) for i, f in enumerate(list(arrow)[: len(keep)])]
            each = [[number] * len(rows), *map(list, zip(*rows)), numbers, times, [None] * len(rows), [None] * len(rows)]
            last = [[None]] * len(keep) + [[number]] + [[None]] * 7 + [[pairs], [holds]]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c, f.type) for c, f in zip(each, list(arrow)[len(keep):])]], schema=arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(last, arrow)], schema=arrow)
            number, block, held = number + 1, _Block(coder), []

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                held.append(part.select(range(len(keep))))
                block.add(part.column(part.num_columns - 1).to_pylist())
                if block.size >= block_chars:
                    yield from out()
        if held:
            yield from out()

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents an id pair (a << 32 | b) is linked, and whether that is the most of its a."""
    each = blocks.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "holds")).alias("x"))
    counts = written(each.where("x.holds > 0").groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.holds").alias("count")), "pair-counts")
    most = counts.groupBy(F.shiftright("pair", 32).alias("_a")).agg(F.max("count").alias("_most"))
    return counts.withColumn("_a", F.shiftright("pair", 32)).join(most, "_a").select("pair", "count", (F.col("count") == F.col("_most")).alias("best"))


def align(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    Byte-level tokens of a space and the text are aligned with the piece model's tokens of the text. Texts null or
    empty, and those that one of the two does not spell byte by byte, have zeros and an empty digest, and count
    nowhere. Every row is a document of its own. Columns named like the added ones are replaced. No rows in, no rows out.
    """
    added = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    docs = docs.drop(*added)
    keep = docs.columns if keep is None else keep
    own = [f"_k{i}" for i in range(len(keep))]
    named = docs.select(*[F.col(f"`{k}`").alias(o) for k, o in zip(keep, own)], F.col(f"`{text}`").alias("_t"))
    blocks = written(aligned_blocks(named, byte_path, piece_path, own, "_t"), "aligned")
    asked = blocks.where("pairs IS NOT NULL").select("block", F.posexplode("pairs").alias("at", "pair"))
    known = asked.join(written(pair_counts(blocks), "pair-bests"), "pair")
    counts = known.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "count", "best"))).alias("_x"))
    counts = counts.select(F.col("block").alias("_block"), F.col("_x.at").alias("at"), F.col("_x.count").alias("count"), F.col("_x.best").alias("best"))
    schema = StructType([named.schema[o] for o in own] + [StructField(c, StringType() if c == "groups_sha256" else LongType()) for c in added])

    def sums(docs, counts):
        n_best, count_sum = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
        if counts.num_rows:
            x = counts.combine_chunks().to_batches()[0]
            at, count = x.column("at")[0].values.to_numpy(), x.column("count")[0].values.to_numpy()
            best = x.column("best")[0].values.to_numpy(zero_copy_only=False)
            size = int(at[-1]) + 1
            value, good = np.zeros(size, np.int64), np.zeros(size, np.int64)
            value[at], good[at] = count, best
            done = 0
            for part in docs.to_batches():
                numbers, times = part.column("numbers"), part.column("times").flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), np.diff(numbers.offsets.to_numpy())) + done
                i = numbers.flatten().to_numpy()
                np.add.at(count_sum, row, times * value[i])
                np.add.at(n_best, row, times * good[i])
                done += part.num_rows
        columns = {c: docs.column(c) for c in [*own, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]}
        columns |= {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
        return pa.table({c: columns[c] for c in [*own, *added]})

    each = blocks.where("pairs IS NULL").drop("pairs", "holds")
    out = each.groupBy("block").cogroup(counts.groupBy("_block")).applyInArrow(sums, schema)
    return out.select(*[F.col(o).alias(k) for k, o in zip(keep, own)], *added)


def op12_shared_cut_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    return align(table(spark, sf_dir, "documents"), files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model"), keep=["doc_id"])
