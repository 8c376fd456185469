"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a pre-token the last token of its encoding is unique. An
automaton over the vocabulary gives all tokens that end at a position; the one
whose predecessor (the stored last token of the shorter prefix) is compatible
with it is the last token there. Following the back-pointers from the end emits
the ids. Time is linear in the pre-token's length for a bounded number of
matches a position, where merging pair by pair would be quadratic.

Texts are cut at white space into chunks that can be encoded alone, and what a
chunk encodes to is kept in a bounded table of the Python worker.

Defined cases: null text counts as empty; an empty text has no ids; repeated
rows give repeated rows; a special token's string in a text becomes that token,
as the library does unless told otherwise; the length of a text is not limited.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame

from glosswork.llm.common import ROOT, table, text_of

#: Pre-token pattern of the byte-level vocabulary (a fixed value of its format).
PRETOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Entries of a worker's table of chunks; it is emptied when full.
CACHE = 400_000
#: Characters of texts that a worker holds cut at a time.
STEP = 1_000_000
#: Runs of white space and special tokens cross the cuts: such texts go whole.
_WHOLE = re.compile(r"\s\s|<\||[\0\1]")


def chunks_of(text: str) -> list[str]:
    """Pieces of a text without runs of white space that encode alone: cut
    before each space and around each line end."""
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes many texts through a bounded table of chunks.

    A subclass says how a text is cut (_cut, None: not at all), and encodes new
    chunks (_new) and texts that cannot be cut (_whole).
    """

    def __init__(self):
        self.chunks: dict[str, bytes] = {}

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (size < STEP or end == at):
                size += len(texts[end])
                end += 1
            out += self._encode_step(texts[at:end])
            at = end
        return out

    def _encode_step(self, texts: list[str]) -> list[bytes]:
        known = self.chunks
        if len(known) >= CACHE:
            known.clear()
        cut = list(map(self._cut, texts))
        new = {c for chunks in cut if chunks for c in chunks}.difference(known)
        if new:
            new = list(new)
            known.update(zip(new, self._new(new), strict=True))
        out = [self._whole(text) if chunks is None else b"".join(map(known.__getitem__, chunks)) for text, chunks in zip(texts, cut, strict=True)]
        if any(len(c) > 256 for c in new):
            for c in new:
                if len(c) > 256:
                    del known[c]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


class PrefixEncoder(Encoder):
    """Byte-level BPE of a tokenizers JSON file, ids ordered by merge rank."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.alphabet = byte_alphabet()
        self.single = {chr(b): c for b, c in self.alphabet.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for merge in spec["model"]["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair, whole = (vocab[left], vocab[right]), vocab[left + right]
            self.merged[pair] = whole
            self.parts.setdefault(whole, pair)
        self.matcher = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.matcher.add_word(token, (i, len(token)))
        self.matcher.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.find = regex.compile(PRETOKEN).findall
        back = {c: b for b, c in self.alphabet.items()}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.right_edge = lru_cache(None)(self._right_edge)
        self.left_edge = lru_cache(None)(self._left_edge)
        self.fits: dict[int, bool] = {}
        self.pretokens: dict[str, bytes] = {}

    def _right_edge(self, token: int) -> list[tuple[int, float]]:
        """Tokens along the right edge of how token was merged, each with the
        merge that used it up (infinite for the token itself)."""
        out, used = [(token, float("inf"))], token
        while token in self.parts:
            token = self.parts[token][1]
            out.append((token, used))
            used = token
        return out

    def _left_edge(self, token: int) -> list[tuple[int, float]]:
        out, used = [(token, float("inf"))], token
        while token in self.parts:
            token = self.parts[token][0]
            out.append((token, used))
            used = token
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether a followed by b is what their joined bytes encode to.

        It is not if two tokens that met at the border would have been merged
        before either was used up; of equal merges the left one comes first.
        """
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            known, merged, left = True, self.merged, self.left_edge(b)
            for x, x_used in self.right_edge(a):
                for y, y_used in left:
                    m = merged.get((x, y))
                    if m is not None and m < x_used and m <= y_used:
                        known = False
            if len(self.fits) > 2 * CACHE:
                self.fits.clear()
            self.fits[key] = known
        return known

    def encode_pretoken(self, pretoken: str) -> list[int]:
        shown = "".join(map(self.alphabet.__getitem__, pretoken.encode()))
        last, start_of = [-1] * (len(shown) + 1), [0] * (len(shown) + 1)
        for end, (token, length) in self.matcher.iter(shown):
            if last[end + 1] < 0:
                start = end + 1 - length
                if start == 0 or self.compatible(last[start], token):
                    last[end + 1], start_of[end + 1] = token, start
        return self._trace(last, start_of)

    @staticmethod
    def _trace(last: list[int], start_of: list[int]) -> list[int]:
        ids, at = [], len(last) - 1
        while at:
            ids.append(last[at])
            at = start_of[at]
        return ids[::-1]

    def _new(self, chunks: list[str]) -> list[bytes]:
        if len(self.pretokens) >= CACHE:
            self.pretokens.clear()
        return [b"".join(map(self._pretoken, self.find(c))) for c in chunks]

    def _pretoken(self, pretoken: str) -> bytes:
        found = self.pretokens.get(pretoken)
        if found is None:
            found = array("I", self.encode_pretoken(pretoken)).tobytes()
            if len(pretoken) <= 64:
                self.pretokens[pretoken] = found
        return found

    def _whole(self, text: str) -> bytes:
        ids: list[int] = []
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                ids.append(self.special[part])
            else:
                for p in self.find(part):
                    ids += self.encode_pretoken(p)
        return array("I", ids).tobytes()

    def _cut(self, text: str) -> list[str] | None:
        return None if _WHOLE.search(text) else chunks_of(text)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class BulkEncoder:
    """Byte-level BPE for counting and packing: the vocabulary of a tokenizers
    file run by a compiled encoder; texts with special tokens or with more white
    space in a row than that encoder's expressions bear go through the library itself."""

    #: The compiled encoder fails at a million.
    WHITE = re.compile(r"\s{100000}")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_alphabet().items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pattern = PRETOKEN.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S")
        self.fast = tiktoken.Encoding("bulk", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def encode(self, text: str) -> bytes:
        """The ids of text as little-endian unsigned 32-bit integers."""
        if "<|" in text or len(text) >= 100_000 and self.WHITE.search(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast(text)).tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return list(map(self.encode, texts))


class WordEncoder(Encoder):
    """BPE with word ends of a tokenizers file whose words are lower-cased and
    whose white space is dropped; texts with odd characters go through the
    library itself.

    A word's last symbol is another one than inside a word. The compiled
    encoder gets it by a mark after each word: the pairs with the mark have the
    lowest ranks, so they merge first.
    """

    #: Pre-token pattern of that vocabulary (a fixed value of its format).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
    #: Final sigma and dotted I lower-case otherwise, str.split() takes the
    #: separators for white space, special tokens cut texts, \1 is the mark.
    ODD = ("\u03a3", "\u0130", "\x1c", "\x1d", "\x1e", "\x1f", "<|", "\1")

    def __init__(self, path: str):
        import numpy as np
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_alphabet().items()}
        end = spec["model"]["end_of_word_suffix"]
        special = {t["content"] for t in spec["added_tokens"]}
        ranks, ends = {}, []
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                last = token.endswith(end) and token != end
                data = bytes(back[c] for c in (token[: -len(end)] if last else token))
                if b"\1" not in data or data == b"\1" and not last:
                    ranks[data + b"\1" * last] = i
                    ends += [i] * last
        self.is_end = np.zeros(max(ranks.values()) + 1, bool)
        self.is_end[ends] = True
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.find = regex.compile(self.PATTERN).findall

    def _new(self, chunks: list[str]) -> list[bytes]:
        import numpy as np

        parts = [[c] if c.isalpha() else self.find(c) for c in chunks]
        ids = np.array(self.fast("".join([p + "\1" for ps in parts for p in ps])), "<u4")
        ends = np.concatenate([[0], np.flatnonzero(self.is_end[ids]) + 1]) if len(ids) else np.zeros(1, np.int64)
        stops = (4 * ends[np.cumsum([len(ps) for ps in parts])]).tolist()
        data, last, out = ids.tobytes(), 0, []
        for stop in stops:
            out.append(data[last:stop])
            last = stop
        return out

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _cut(self, text: str) -> list[str] | None:
        if any(c in text for c in self.ODD) or not unicodedata.is_normalized("NFC", text):
            return None
        return text.lower().split()


@lru_cache(2)
def prefix_encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


@lru_cache(2)
def bulk_encoder(path: str) -> BulkEncoder:
    return BulkEncoder(path)


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded (string) of every text."""
    root = ROOT

    def run(batches):
        import sys

        import numpy as np
        import pyarrow as pa

        if root not in sys.path:
            sys.path.append(root)
        from glosswork.llm.bpe import prefix_encoder

        coder = prefix_encoder(tokenizer_path)
        for batch in batches:
            ids = [np.frombuffer(x, "<u4") for x in coder.encode_many(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32())), pa.array([coder.decode(x.tolist()) for x in ids], pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    return text_of(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode_decode() reduced in the worker."""
    root = ROOT

    def run(batches):
        import hashlib
        import sys

        import numpy as np
        import pyarrow as pa

        if root not in sys.path:
            sys.path.append(root)
        from glosswork.llm.bpe import prefix_encoder

        coder = prefix_encoder(tokenizer_path)
        for batch in batches:
            n, a, b = [], [], []
            for at in range(0, batch.num_rows, 256):
                for ids in coder.encode_many(batch.column("text").slice(at, 256).to_pylist()):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(coder.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return text_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir):
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
