"""Byte-level BPE encoding by prefix-sharing trie traversal, and decoding.

A token sequence is the BPE encoding of its bytes exactly when every token
encodes to itself and every two neighbours may stand side by side, so the
encoding of a prefix has one possible last token.  That token is the state of a
prefix: the state of a longer one is the token that ends it and may follow the
state of the prefix before that token.

Texts are cut into words as the tokenizer does.  Distinct words go into a trie;
a depth-first walk over it carries the last tokens of the path, so a prefix
that many words share gets its states once.  A word's encoding is read back
from the states on its path.  Encodings of words are kept in a bounded table
between blocks of text.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from itertools import islice
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches

TOKENIZER = "byte_bpe_50k.json"
BLOCK_WORDS = 200_000
MAX_WORDS = 800_000       # words whose encodings are kept
MAX_KEPT_CHARS = 64       # a longer word's encoding is not kept between blocks
MAX_PAIRS = 500_000       # neighbours whose verdict is kept
NEAR = 32                 # bytes of neighbouring words compared at once

# fixed value: how the tokenizer's byte-level step cuts words, for classes of
# letters, numbers and other characters that are no white space
WORD = r""" ?{letter}+| ?{number}+|'(?:s|t|re|ve|m|ll|d)| ?{other}+|\s+(?!\S)|\s+"""

# fixed values: letters and numbers that Unicode got after the version that the
# tokenizer's library knows (16); to it they are neither
NEWER_RANGES = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6
1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
NEWER = "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in NEWER_RANGES.split())


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable
    Latin-1 bytes stand for themselves, others are numbered from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def token_bytes(spec: dict) -> list[bytes]:
    """The bytes that each id of a tokenizer file stands for."""
    letters, ids, added = byte_letters(), spec["model"]["vocab"], spec.get("added_tokens") or []
    out = [b""] * (max([*ids.values(), *(a["id"] for a in added)], default=-1) + 1)
    for token, i in ids.items():
        out[i] = bytes([letters[c] for c in token])
    for a in added:
        out[a["id"]] = a["content"].encode()
    return out


class Vocabulary:
    """Tokens, their merges, and the tokens that end with given bytes."""

    def __init__(self, spec: dict):
        model = spec["model"]
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        if (model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
                or not pre.get("use_regex", True) or spec.get("normalizer") or spec.get("post_processor")
                or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))):
            raise ValueError("a byte-level BPE tokenizer without normaliser, prefix space and dropout is expected")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError("added tokens that take in what is around them are not handled")
        ids = model["vocab"]
        self.added = {a["content"]: a["id"] for a in added}
        self.bytes = token_bytes(spec)
        self.sizes = [len(t) for t in self.bytes]
        self.raw = [array("i", [i]).tobytes() for i in range(len(self.bytes))]
        parts = sorted(self.added, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, parts)) + ")") if parts else None
        self.ascii_words = re.compile(WORD.format(letter="[A-Za-z]", number="[0-9]", other=r"[^\sA-Za-z0-9]"), re.ASCII)
        self.words = regex.compile(WORD.format(letter=r"\p{L}", number=r"\p{N}", other=r"[^\s\p{L}\p{N}]"))
        self.words_of_newer = regex.compile(WORD.format(
            letter=rf"[\p{{L}}--[{NEWER}]]", number=rf"[\p{{N}}--[{NEWER}]]",
            other=rf"[[^\s\p{{L}}\p{{N}}]||[{NEWER}]]"), regex.V1)
        self.newer, self.maybe_newer = regex.compile(f"[{NEWER}]"), regex.compile(f"[{NEWER[0]}-{chr(0x10FFFF)}]")
        self._merges(ids, model["merges"])
        self._endings(ids)

    def _merges(self, ids, merges) -> None:
        size = len(self.bytes)
        self.first, self.second, self.made = [-1] * size, [-1] * size, [-1] * size
        self.rank: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = ids[left], ids[right], ids[left + right]
            if self.made[whole] >= 0 or max(self.made[a], self.made[b]) > rank:
                raise ValueError("each token must come from one merge of tokens that were merged before")
            self.rank[a, b] = rank
            self.first[whole], self.second[whole], self.made[whole] = a, b, rank
        self.verdicts: dict[int, bool] = {}

    def _endings(self, ids) -> None:
        """A trie of the tokens read from their last byte to their first."""
        self.back: dict[int, int] = {}
        self.token_at = [-1]
        for i in ids.values():
            t = self.bytes[i]
            # a token that its own bytes do not encode to never comes out
            if self.made[i] < 0 and len(t) > 1 or self.made[i] >= 0 and not self._stands(self.first[i], self.second[i], self.made[i]):
                continue
            node = 0
            for byte in reversed(t):
                to = self.back.get(node << 8 | byte)
                if to is None:
                    to = self.back[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                node = to
            self.token_at[node] = i

    def _stands(self, left: int, right: int, until: int) -> bool:
        """Whether no merge of a rank below ``until`` crosses from ``left`` into
        ``right``.  The pieces that face each other are followed back in time:
        the one merged last is undone first, of equal ones the right one, since
        equal merges are done from the left."""
        left_end = right_end = until
        while True:
            r = self.rank.get((left, right))
            if r is not None and r < left_end and r <= right_end and r < until:
                return False
            if self.made[left] < 0 and self.made[right] < 0:
                return True
            if self.made[left] > self.made[right]:
                left_end, left = self.made[left], self.second[left]
            else:
                right_end, right = self.made[right], self.first[right]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` may be neighbours in an encoding."""
        if len(self.verdicts) >= MAX_PAIRS:
            self.verdicts.clear()
        known = self.verdicts[left << 32 | right] = self._stands(left, right, 1 << 62)
        return known

    def extend(self, data: bytes, states: list) -> None:
        """Adds the last token of each prefix of ``data`` that ``states`` does
        not hold yet: the tokens that end a prefix are read backwards, and the
        one that may follow the state before it is the state."""
        back, token_at, verdicts = self.back.get, self.token_at, self.verdicts.get
        for depth in range(len(states), len(data) + 1):
            node, at, state = 0, depth, -1
            while at:
                at -= 1
                node = back(node << 8 | data[at])
                if node is None:
                    break
                token = token_at[node]
                if token >= 0:
                    if not at:
                        state = token
                        break
                    ok = verdicts(states[at] << 32 | token)
                    if ok is None:
                        ok = self.may_follow(states[at], token)
                    if ok:
                        state = token
                        break
            if state < 0:
                raise ValueError(f"no token ends the bytes {bytes(data[max(0, depth - 16):depth])!r}")
            states.append(state)


class Trie:
    """A trie of byte strings in array form: its words in byte order, which is
    depth-first order, and the depth at which each leaves the path of the one
    before."""

    def __init__(self, words):
        self.words = sorted(set(words))
        self.shared = [0] * len(self.words)
        if len(self.words) > 1:
            size = np.fromiter(map(len, self.words), dtype=np.int64, count=len(self.words))
            data = np.frombuffer(b"".join(self.words) + bytes(NEAR), dtype=np.uint8)
            start = np.cumsum(size) - size
            most = np.minimum(size[1:], size[:-1])
            depth, live = np.zeros(len(most), dtype=np.int64), np.arange(len(most))
            for k in range(NEAR):
                live = live[(most[live] > k) & (data[start[live] + k] == data[start[live + 1] + k])]
                depth[live] = k + 1
            for i in live:  # words that agree further than the loop went
                depth[i] = _shared(self.words[i], self.words[i + 1])
            self.shared[1:] = depth.tolist()


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix; halving keeps long words out of a loop."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def encode_words(vocab: Vocabulary, words) -> dict[bytes, bytes]:
    """Encodings (int32 ids as bytes) of distinct words by one walk over their
    trie, depth first: the states of the path are cut back to where a word
    leaves it and extended by the word's own bytes.  Memory follows the longest
    word."""
    out, sizes, raw = {}, vocab.sizes, vocab.raw
    trie, states = Trie(words), [-1]
    for word, shared in zip(trie.words, trie.shared):
        del states[shared + 1:]
        vocab.extend(word, states)
        ids, at = [], len(word)
        while at:
            token = states[at]
            ids.append(raw[token])
            at -= sizes[token]
        ids.reverse()
        out[word] = b"".join(ids)
    return out


class Encoder:
    """Encodes texts block by block; see :func:`encode_words`."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.known: dict[str, bytes] = {}

    def words(self, text: str):
        """Words of a text in order, in lists of ``BLOCK_WORDS`` at most; an
        added token's string is one word."""
        v = self.vocab
        for k, part in enumerate(v.split.split(text) if v.split else [text]):
            if k % 2:
                yield [part]
            elif part:
                if part.isascii():
                    cut = v.ascii_words
                else:
                    cut = v.words_of_newer if v.maybe_newer.search(part) and v.newer.search(part) else v.words
                if len(part) <= BLOCK_WORDS:  # no more words than characters
                    yield cut.findall(part)
                else:
                    found = cut.finditer(part)
                    while some := [m[0] for m in islice(found, BLOCK_WORDS)]:
                        yield some

    def coded(self, words: list[str]) -> list[bytes]:
        """The ids of each word; words not known yet are encoded together."""
        if not self.known or len(self.known) >= MAX_WORDS:
            self.known = {s: array("i", [i]).tobytes() for s, i in self.vocab.added.items()}
        known = self.known
        out = list(map(known.get, words))
        new = {w.encode(): w for w, ids in zip(words, out) if ids is None}
        if new:
            for raw, ids in encode_words(self.vocab, new).items():
                known[new[raw]] = ids
            out = list(map(known.__getitem__, words))
            for w in new.values():
                if len(w) > MAX_KEPT_CHARS:
                    del known[w]
        return out

    def encode(self, texts) -> list[bytes]:
        """Ids of each text as int32 bytes.  Small texts share a block of words,
        a large one is taken in several."""
        found = [bytearray() for _ in texts]
        block, owners = [], []

        def flush():
            ids = self.coded(block)
            for k, a, b in owners:
                found[k] += b"".join(ids[a:b])
            block.clear()
            owners.clear()

        for k, text in enumerate(texts):
            for some in self.words(text):
                owners.append((k, len(block), len(block) + len(some)))
                block += some
                if len(block) >= BLOCK_WORDS:
                    flush()
        flush()
        return [bytes(f) for f in found]


class Decoder:
    """The bytes of each token id; that is all that decoding needs."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens

    def decode(self, ids) -> str:
        """The text of token ids, special tokens included; bytes that are no
        UTF-8 become U+FFFD and ids outside the vocabulary nothing."""
        try:
            if min(ids, default=0) < 0:
                raise IndexError
            raw = b"".join(map(self.tokens.__getitem__, ids))
        except IndexError:
            raw = b"".join([self.tokens[i] for i in ids if 0 <= i < len(self.tokens)])
        return raw.decode("utf-8", "replace")


def _load(name: str, make, tokenizer: str):
    """What ``make`` builds from a tokenizer file, once per process.  Functions
    come to a Python worker by value, task by task, so what shall outlast a task
    is held by a module of the worker's own."""
    held = vars(sys.modules.setdefault("_bpe_of_this_process", ModuleType("_bpe_of_this_process")))
    key = f"{name}:{tokenizer}"
    if key not in held:
        import public_tokenizers

        with open(public_tokenizers.path(tokenizer), encoding="utf-8") as f:
            held[key] = make(json.load(f))
    return held[key]


def load_encoder(tokenizer: str = TOKENIZER) -> Encoder:
    return _load("encoder", lambda spec: Encoder(Vocabulary(spec)), tokenizer)


def load_decoder(tokenizer: str = TOKENIZER) -> Decoder:
    return _load("decoder", lambda spec: Decoder(token_bytes(spec)), tokenizer)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, ids array<int>)`` for each row: the token ids of the whole text.

    Null and empty texts have no ids; null and repeated ids and repeated rows
    are returned as they come, an empty table gives an empty table, other
    columns are not read.  A text is never cut: its words are taken in blocks of
    ``BLOCK_WORDS``, so a task holds its batch of texts, their ids and the tries
    of one block.  One scan, no shuffle.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = load_encoder(tokenizer)
        for b in batches:
            found = encoder.encode([t.as_py().decode("utf-8", "replace") for t in b.column(1)])
            ends = np.cumsum([0, *(len(f) // 4 for f in found)], dtype=np.int64)
            ids = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids.cast(pa.list_(pa.int32()))], ["doc_id", "ids"])

    return src.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, ids_col: str = "ids", tokenizer: str = TOKENIZER, out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids added as ``out_col``; null ids give
    an empty text and a null id none.  No shuffle."""
    bounded_batches(encoded.sparkSession)
    if out_col in encoded.columns:
        raise ValueError(f"there is a column {out_col} already")
    at = encoded.columns.index(ids_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + f", `{out_col}` string"
    names = [*encoded.columns, out_col]

    def run(batches):
        text = load_decoder(tokenizer).decode
        for b in batches:
            column = b.column(at)
            ids = pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False)
            edge = np.cumsum([0, *pc.fill_null(pc.list_value_length(column), 0).to_numpy()])
            texts = [text(ids[i:j].tolist()) for i, j in zip(edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names)

    return encoded.mapInArrow(run, schema)


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
