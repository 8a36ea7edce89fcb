"""BPE encoding and decoding: speculate with greedy longest match, verify adjacent pairs, merge what fails.

A token sequence is the BPE encoding of a word exactly if every two neighbours, encoded by themselves, come
out as those two tokens again. So each new word gets a greedy longest-match proposal; all neighbouring pairs
of a batch are tested at once against a sorted table of pairs tested before; pairs seen for the first time
are settled by merging two tokens; only words with a failing pair are merged in full.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.shared import kept, map_batches, table

_END = "</w>"
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Outside these characters the tokenizer's own normalizer and pre-tokenizer split the text into words.
_UNUSUAL = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa0-\\u024f\\u2010-\\u2015\\u2018-\\u201f\\u2026\\u20ac]")
_ALONE = 0xFFFF
_LONG = 100
_NONE = 1 << 62


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Encodes words given in the byte-level alphabet."""

    def __init__(self, path: str, most_pairs: int = 2_000_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: pair code -> rank and new token in one number, so that the smallest number is the next merge
        self.rank = {vocab[a] << 16 | vocab[b]: i << 16 | vocab[a + b] for i, (a, b) in enumerate(pairs)}
        self.inner = {k: v for k, v in vocab.items() if not k.endswith(_END)}
        self.final = {k[: -len(_END)]: v for k, v in vocab.items() if k.endswith(_END)}
        self.text = {v: k for k, v in vocab.items()}
        self.longest = max(map(len, self.final))
        sizes: dict[str, set[int]] = {}  # of inner tokens that begin with the same three characters
        for k in self.inner:
            sizes.setdefault(k[:3], {1, 2}).add(len(k))
        self.sizes = {k: tuple(sorted(v, reverse=True)) for k, v in sizes.items()}
        self.most_pairs = most_pairs
        self._forget()

    def _forget(self) -> None:
        self.codes, self.good = np.empty(0, np.uint32), np.empty(0, bool)

    def merge(self, symbols: list[int]) -> list[int]:
        """Exact merging: always the lowest-ranked pair, leftmost first."""
        if len(symbols) > 64:
            return self._merge_long(symbols)
        ids, get, none = list(symbols), self.rank.get, _NONE
        ranks = [get(a << 16 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) != none:
            i = ranks.index(least)
            ids[i : i + 2] = [least & 0xFFFF]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 16 | ids[i], none)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 16 | ids[i + 1], none)
        return ids

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same with a heap of pairs and linked neighbours, for words of any length."""
        n, get = len(symbols), self.rank.get
        ids, left, right = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := get(a << 16 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = r & 0xFFFF, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := get(ids[x] << 16 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [t for t in ids if t >= 0]

    def symbols(self, word: str) -> list[int]:
        return [self.inner[c] for c in word[:-1]] + [self.final[word[-1]]]

    def propose(self, word: str) -> list[int]:
        """Greedy longest match from the left; the last token ends the word."""
        out, i, n, inner, final, sizes = [], 0, len(word), self.inner, self.final, self.sizes
        while True:
            if n - i <= self.longest and (t := final.get(word[i:])) is not None:
                out.append(t)
                return out
            for size in sizes.get(word[i : i + 3], (2, 1)):
                if i + size < n and (t := inner.get(word[i : i + size])) is not None:
                    out.append(t)
                    i += size
                    break

    def _settle(self, code: int) -> bool:
        a, b = code >> 16, code & 0xFFFF
        tokens = [a] if b == _ALONE else [a, b]
        symbols = []
        for t in tokens:
            s = self.text[t]
            symbols += self.symbols(s[: -len(_END)]) if s.endswith(_END) else [self.inner[c] for c in s]
        return self.merge(symbols) == tokens

    def compatible(self, codes: np.ndarray) -> np.ndarray:
        """For each pair code (left << 16 | right): do the two tokens stay as they are?"""
        wanted, back = np.unique(codes, return_inverse=True)
        at = np.searchsorted(self.codes, wanted)
        known = np.zeros(len(wanted), bool)
        inside = at < len(self.codes)
        known[inside] = self.codes[at[inside]] == wanted[inside]
        fresh = wanted[~known]
        if len(fresh):
            if len(self.codes) + len(fresh) > self.most_pairs:
                self._forget()
                fresh = wanted
            settled = np.fromiter(map(self._settle, fresh.tolist()), bool, len(fresh))
            codes_, good = np.concatenate([self.codes, fresh]), np.concatenate([self.good, settled])
            order = np.argsort(codes_)
            self.codes, self.good = codes_[order], good[order]
            at = np.searchsorted(self.codes, wanted)
        return self.good[at][back]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids one after another, and how many each word has."""
        if not words:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        out = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter(chain.from_iterable(out), np.uint32, int(sizes.sum()))
        last = np.cumsum(sizes) - 1
        right = np.append(flat[1:], np.uint32(_ALONE))
        single = sizes == 1
        right[last[single]] = _ALONE
        tested = np.ones(len(flat), bool)
        tested[last[~single]] = False  # the end of a word has no right neighbour
        ok = np.ones(len(flat), bool)
        ok[tested] = self.compatible((flat[tested] << np.uint32(16)) | right[tested])
        bad = np.unique(np.searchsorted(last, np.flatnonzero(~ok))).tolist()
        if not bad:
            return flat, sizes
        for i in bad:
            out[i] = self.merge(self.symbols(words[i]))
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.uint32, int(sizes.sum())), sizes


class LibraryWords:
    """The same interface, encoded by the tokenizers library's own model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.model.normalizer, self.model.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.model.encode_special_tokens = True
        vocab = self.model.get_vocab()
        self.ends = np.zeros(1 + max(vocab.values()), bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(_END)]] = True

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # words of the byte-level alphabet hold no white space, and only a word's last token ends a word
        flat = np.array(self.model.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
        return flat, np.diff(np.flatnonzero(self.ends[flat]), prepend=-1)


class TextEncoder:
    """Whole texts to token ids and back.

    Ids of words, and of runs between white space, are kept until there are most_words of them; runs longer than
    _LONG characters are encoded anew each time, so the memory is bounded.
    """

    def __init__(self, path: str, words: WordEncoder | LibraryWords, most_words: int = 250_000):
        from tokenizers import Tokenizer

        self.words = words
        self.library = Tokenizer.from_file(path)
        self.alphabet = {b: ord(c) for b, c in byte_alphabet().items()} | {0x20: 0x20}
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.is_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        by_id = {i: t for t, i in self.library.get_vocab().items()}
        self.tokens = pa.array([by_id.get(i, "") for i in range(1 + max(by_id))], pa.string())
        self.cache = {"": b""}  # white space at either end of a text leaves an empty run
        self.most_words = most_words

    def _mapped(self, words: list[str]) -> list[str]:
        """In the byte-level alphabet."""
        return " ".join(words).encode().decode("latin-1").translate(self.alphabet).split(" ") if words else []

    def _learn(self, runs: list[str]) -> None:
        plain = [r for r in runs if r.isalpha()]  # words as they are; only the others need splitting
        parts = {r: _WORD.findall(r) for r in runs if not r.isalpha()}
        new = list({w for w in set(chain.from_iterable(parts.values())) if w not in self.cache}.union(plain))
        flat, sizes = self.words.encode(self._mapped(new))
        ids, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        self.cache.update(zip(new, [ids[a:b] for a, b in zip([0, *ends], ends)]))
        for r, x in parts.items():
            if len(x) > 1:
                self.cache[r] = b"".join([self.cache[w] for w in x])
        self.passing = [w for w in [*new, *parts] if len(w) > _LONG]

    def _unusual(self, text: str) -> np.ndarray:
        out = [np.empty(0, np.uint32)]
        for piece in self.is_special.split(text) if self.is_special else [text]:
            if piece in self.special:
                out.append(np.array([self.special[piece]], np.uint32))
            elif piece:
                plain = self.library.normalizer.normalize_str(piece)
                words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
                if words:
                    out.append(self.words.encode(words)[0])
        return np.concatenate(out)

    def _usual(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Runs between white space are numbered by Arrow; each distinct one is looked up once."""
        split = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        numbered = split.flatten().dictionary_encode()
        runs = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = [*map(self.cache.get, runs)]
        fresh = [r for r, ids in zip(runs, known) if ids is None]
        if len(self.cache) + len(fresh) > self.most_words:  # runs of these texts stay, among them the frequent ones
            self.cache = {"": b""} | {r: ids for r, ids in zip(runs, known) if ids is not None}
        if fresh:
            self._learn(fresh)
            known = [self.cache[r] if ids is None else ids for r, ids in zip(runs, known)]
            for w in self.passing:
                self.cache.pop(w, None)
        ids, sizes = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        first, at = np.cumsum(sizes) - sizes, numbered.indices.to_numpy()
        n = sizes[at]
        until = np.cumsum(n)
        flat = ids[np.arange(until[-1] if len(until) else 0) + np.repeat(first[at] - until + n, n)]
        return flat, np.diff(np.append(0, until)[split.offsets.to_numpy()])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and how many each text has."""
        usual, other = [], {}
        for i, t in enumerate(texts):
            if not t:
                usual.append("")
            elif _UNUSUAL.search(t) or self.is_special and self.is_special.search(t):
                other[i] = self._unusual(t)
                usual.append("")
            else:
                usual.append(unicodedata.normalize("NFC", t).lower())
        flat, sizes = self._usual(usual)
        if other:
            at = np.cumsum(sizes).tolist()
            parts, done = [], 0
            for i, ids in other.items():
                parts += [flat[done : at[i]], ids]
                done, sizes[i] = at[i], len(ids)
            flat = np.concatenate([*parts, flat[done:]])
        return flat, sizes

    def decode(self, flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """As the library decodes without a decoder: the tokens' own strings, joined by spaces."""
        ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(ends, self.tokens.take(pa.array(flat))), " ")


def packed(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Ids packed as little-endian unsigned 32-bit, one binary for each size."""
    ends = np.append(0, 4 * np.cumsum(sizes)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(flat.astype("<u4").tobytes())])


def encoder(path: str, by_library: bool = False) -> TextEncoder:
    """One encoder for each Python worker, so that its cache serves all its tasks."""
    return kept(("encoder", path, by_library), lambda: TextEncoder(path, (LibraryWords if by_library else WordEncoder)(path)))


def encode_texts(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None,
                 decode: bool = True, rows: int = 2000) -> DataFrame:
    """docs (or its columns keep) with ids, packed little-endian unsigned 32-bit ids, and decoded.

    Every whole text is encoded as the tokenizers library does with the file at path, without special tokens
    added; special tokens' strings inside a text count as those tokens. Null and empty texts give no ids and
    an empty string. Columns of docs named ids or decoded are replaced. No rows in, no rows out.
    """
    docs = docs.drop("ids", "decoded")
    keep = docs.columns if keep is None else keep

    def make():
        coder = encoder(path)

        def work(batch):
            ids = coder.encode(batch.column(text).to_pylist())
            return None, [packed(*ids), coder.decode(*ids)] if decode else [packed(*ids)]

        return work

    added = "ids binary, decoded string" if decode else "ids binary"
    return map_batches(docs.select(*dict.fromkeys([*keep, text])), make, added, keep, rows, keeps=True)


def op5_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
