"""BPE encoding and decoding with forced-boundary splitting.

A byte pair that no vocabulary token holds inside can never be covered by a merge, so a text may be
cut there for certain and its fragments encoded on their own; the ids of the text are the ids of
its fragments, one after the other.  White space is the commonest such boundary: the pre-tokenizer
drops it.  A block of texts is coded by its distinct pieces between ASCII white space; they are cut at
their words and forced boundaries by table, and the merges of all their fragments run side by side as
array operations, one merge a fragment and step.  Nothing is remembered from one block to the next.

The vocabulary file (``tokenizers`` JSON of a byte-level BPE model with an end-of-word suffix, without
a prefix space and without a decoder) is a parameter; another kind raises ValueError.  Its own
normaliser and pre-tokenizer are applied to pieces with letters beyond U+00FF, marks that may combine,
or apostrophes; fragments of more than ``LONGEST`` bytes are merged by the library's model.  Strings of
added tokens found in a text are those tokens, as the library has it.  Null and empty texts have no ids
and decode to the empty text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import common

#: Bytes of text whose pieces are told apart at once.
BLOCK_BYTES = 4_000_000
#: Bytes up to which a fragment is merged beside the others.
LONGEST = 64

#: Printable ASCII but the apostrophe, and the letters U+00C0 to U+00FF: no normal form changes them, and their classes are plain.
_PLAIN = r"\A(?:[!-&(-~]|[\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])+\z"
#: Classes of the bytes of plain pieces in lower case: letter, digit, other.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[*range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 0
_CLASS[48:58] = 1
# The character that the byte-level alphabet shows for each byte.
_SHOWN = [chr(b) for b in range(256)]
for _i, _b in enumerate([*range(33), *range(127, 161), 173]):
    _SHOWN[_b] = chr(256 + _i)
_BYTE = {c: b for b, c in enumerate(_SHOWN)}
_NEVER = np.int32(2**31 - 1)


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        steps = pre.get("pretokenizers", [pre])
        plain = model["type"] == "BPE" and model["end_of_word_suffix"] and not model.get("continuing_subword_prefix") and not model.get("dropout") and not model.get("ignore_merges")
        if not plain or steps[0].get("type") != "Split" or steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or any(s.get("add_prefix_space") for s in steps):
            raise ValueError(f"{path}: only BPE models whose pre-tokenizer drops white space are supported")
        if spec["decoder"] or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: decoders, and added tokens that are normalised or take white space, are not supported")
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str if library.normalizer else lambda s: s
        self.pre_tokenize = library.pre_tokenizer.pre_tokenize_str
        suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # a fragment inside a word has no suffix, the last one has
        self.inner = models.BPE(vocab, merges).tokenize
        self.final = models.BPE(vocab, merges, end_of_word_suffix=suffix).tokenize
        self.lowers = "Lowercase" in json.dumps(spec["normalizer"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.n_ids = max(tokens) + 1
        #: The tokens' strings and a space, by id.
        self.spelled = pa.array([tokens.get(i, "").encode() + b" " for i in range(self.n_ids)], pa.large_binary())
        self.special = re.compile(b"(" + b"|".join(re.escape(t.encode()) for t in sorted(self.added, key=len, reverse=True)) + b")") if self.added else None
        self.odd = "|".join(["[\\x{300}-\\x{36f}]", *map(re.escape, self.added)])
        #: Whether words can be told by the classes of their letters: letters, a digit, or neither; apostrophes aside.
        words = re.split(r"(?<!\\)\|", steps[0]["pattern"].get("Regex", ""))
        self.by_class = self.lowers and {w for w in words if w[:1] != "'" and not w.startswith("<")} == {r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"}
        #: Byte pairs that lie inside a token.
        self.inside = np.zeros((256, 256), bool)
        for token in vocab:
            held = [_BYTE.get(ch, 0) for ch in token.removesuffix(suffix)]
            self.inside[held[:-1], held[1:]] = True
        if any(c not in vocab or c + suffix not in vocab for c in _SHOWN):
            raise ValueError(f"{path}: not every byte has a token")
        self.symbol = np.array([vocab[c] for c in _SHOWN], np.int32)
        self.symbol_last = np.array([vocab[c + suffix] for c in _SHOWN], np.int32)
        pairs = {(vocab[a] << 32) | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.rank_of = np.array([pairs[p][0] for p in self.pairs.tolist()], np.int32)
        self.made = np.zeros(len(merges) + 1, np.int32)
        self.made[self.rank_of] = [pairs[p][1] for p in self.pairs.tolist()]
        self.first_rank = self.ranks(np.repeat(self.symbol, 256), np.tile(self.symbol, 256)).reshape(256, 256)
        self.first_rank_last = self.ranks(np.repeat(self.symbol, 256), np.tile(self.symbol_last, 256)).reshape(256, 256)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of the merges of symbols ``a`` and ``b``."""
        wanted = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.rank_of[at], _NEVER)

    def fragments(self, data: np.ndarray, word_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the fragments of words start, and whether each is its word's last: words are cut at the forced boundaries."""
        starts = word_starts.copy()
        starts[1:] |= ~self.inside[data[:-1], data[1:]]
        at = np.flatnonzero(starts)
        return at, np.r_[word_starts[at[1:]], True][: len(at)]

    def merge(self, data: np.ndarray, at: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of fragments of ``data`` that start at ``at``, one after the other, and the number of each's."""
        n = len(at)
        if not n:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        sizes = np.diff(np.r_[at, len(data)])
        ends = at + sizes - 1
        symbols = self.symbol[data]
        symbols[ends[last]] = self.symbol_last[data[ends[last]]]
        rank = np.full(len(data), _NEVER)
        rank[:-1] = self.first_rank[data[:-1], data[1:]]
        closing = ends[last & (sizes > 1)]
        rank[closing - 1] = self.first_rank_last[data[closing - 1], data[closing]]
        rank[ends] = _NEVER
        fragment = np.repeat(np.arange(n, dtype=np.int32), sizes)
        long = sizes > LONGEST
        done_symbols, done_fragments = [], []
        for i in np.flatnonzero(long).tolist():
            word = "".join(map(_SHOWN.__getitem__, data[at[i] : at[i] + sizes[i]].tolist()))
            ids = [t.id for t in (self.final if last[i] else self.inner)(word)]
            done_symbols.append(np.array(ids, np.int32))
            done_fragments.append(np.full(len(ids), i, np.int32))
        if long.any():
            keep = ~np.repeat(long, sizes)
            symbols, rank, fragment = symbols[keep], rank[keep], fragment[keep]
        while len(symbols):
            fresh = np.r_[True, fragment[1:] != fragment[:-1]]
            starts = np.flatnonzero(fresh)
            least = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(symbols)])
            open_ = least != _NEVER
            if not open_.all():  # fragments without a merge are done
                keep = np.repeat(open_, counts)
                done_symbols.append(symbols[~keep])
                done_fragments.append(fragment[~keep])
                symbols, rank, fragment, fresh = symbols[keep], rank[keep], fragment[keep], fresh[keep]
                least, counts = least[open_], counts[open_]
                if not len(symbols):
                    break
            # the leftmost pair of the least rank
            found = np.flatnonzero(rank == np.repeat(least, counts))
            found = found[np.r_[True, fragment[found[1:]] != fragment[found[:-1]]]]
            symbols[found] = self.made[least]
            keep = np.ones(len(symbols), bool)
            keep[found + 1] = False
            symbols, rank, fragment, fresh = symbols[keep], rank[keep], fragment[keep], fresh[keep]
            found -= np.arange(len(found))  # every fragment before lost a symbol
            ends = np.r_[fresh[1:], True]
            right, left = found[~ends[found]], found[~fresh[found]]
            rank[found] = _NEVER
            rank[right] = self.ranks(symbols[right], symbols[right + 1])
            rank[left - 1] = self.ranks(symbols[left - 1], symbols[left])
        fragment = np.concatenate(done_fragments)
        order = np.argsort(fragment, kind="stable")
        return np.concatenate(done_symbols)[order].astype(np.uint32), np.bincount(fragment, minlength=n)

    def words(self, piece: str) -> list[bytes]:
        """Words of a piece in bytes, as the file's normaliser and pre-tokenizer make them."""
        return [bytes(map(_BYTE.__getitem__, w)) for w, _ in self.pre_tokenize(self.normalize(piece))]

    def code_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of some pieces between white space, in no order, and where each piece's start and end."""
        plain = np.zeros(len(pieces), bool)
        if self.by_class:
            plain = pc.match_substring_regex(pieces, _PLAIN).to_numpy(zero_copy_only=False)
        slow = [(i, w) for i, piece in zip(np.flatnonzero(~plain).tolist(), pieces.filter(pa.array(~plain)).to_pylist(), strict=True) for w in self.words(piece)]
        fast = pa.concat_arrays([pieces.filter(pa.array(plain)).cast(pa.large_binary())])
        offsets = np.frombuffer(fast.buffers()[1], np.int64)[fast.offset : fast.offset + len(fast) + 1]
        data = np.frombuffer(fast.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].copy()
        upper = (data >= 65) & (data <= 90)
        upper[1:] |= (data[:-1] == 0xC3) & (data[1:] < 0x9F)
        data[upper] += 32
        kind = _CLASS[data]
        starts = kind == 1
        starts[1:] |= kind[1:] != kind[:-1]
        starts[offsets[:-1] - offsets[0]] = True
        owner = np.repeat(np.flatnonzero(plain), np.diff(offsets))
        more = np.frombuffer(b"".join(w for _, w in slow), np.uint8)
        sizes = np.fromiter((len(w) for _, w in slow), np.int64, len(slow))
        more_starts = np.zeros(len(more), bool)
        more_starts[np.cumsum(sizes) - sizes] = True
        data, starts = np.r_[data, more], np.r_[starts, more_starts]
        owner = np.r_[owner, np.repeat(np.fromiter((i for i, _ in slow), np.int64, len(slow)), sizes)]
        at, last = self.fragments(data, starts)
        ids, lengths = self.merge(data, at, last)
        # a piece's fragments follow each other
        length = np.bincount(owner[at], weights=lengths, minlength=len(pieces)).astype(np.int64)
        start = np.zeros(len(pieces), np.int64)
        heads = np.flatnonzero(np.r_[True, owner[at[1:]] != owner[at[:-1]]]) if len(at) else at
        start[owner[at[heads]]] = (np.cumsum(lengths) - lengths)[heads]
        return ids, start, length

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after the other, and where each text's start, with the end."""
        texts = common.whole_strings(texts)
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        whole = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        ids, cuts = self._encode_plain(whole)
        if odd.any():
            parts = [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            for i in np.flatnonzero(odd).tolist():
                parts[i] = self._encode_odd(texts[i].as_py().encode())
            ids, cuts = np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
        return ids, cuts

    def _encode_plain(self, texts: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if fold and self.lowers else texts)
        coded = lists.flatten().dictionary_encode()
        flat, start, length = self.code_pieces(coded.dictionary)
        at = coded.indices.to_numpy(zero_copy_only=False)
        length = length[at]
        ends = np.cumsum(length)
        ids = flat[np.repeat(start[at] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.r_[0, ends][lists.offsets.to_numpy() - lists.offsets[0].as_py()]

    def _encode_odd(self, data: bytes) -> np.ndarray:
        """A text with combining marks or added tokens."""
        out = []
        for i, part in enumerate(self.special.split(data) if self.special else [data]):
            out.append(np.array([self.added[part.decode()]], np.uint32) if i % 2 else self._encode_plain(pa.array([part.decode()], pa.large_string()), fold=False)[0])
        return np.concatenate(out)

    def encode_blocks(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES, side="right")))
            yield self.encode_block(texts.slice(at, upto - at))
            at = upto

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, block by block."""
        for ids, cuts in self.encode_blocks(texts):
            yield from (ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(ids.astype("<u4").tobytes() for ids in self.encode_all(pa.array([text], pa.string())))

    def decode_block(self, ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """The tokens' strings of each text with a space between, in UTF-8: what a file without a decoder gives."""
        out = self.spelled.take(pa.array(ids))
        places = np.frombuffer(out.buffers()[1], np.int64)[out.offset : out.offset + len(out) + 1][cuts]
        data = memoryview(out.buffers()[2] or b"")
        return [bytes(data[a : max(a, b - 1)]) for a, b in zip(places.tolist(), places[1:].tolist(), strict=False)]

    def decode(self, ids: bytes) -> bytes:
        found = np.frombuffer(ids, "<u4")
        return self.decode_block(found, np.array([0, len(found)]))[0]


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The encoder of this worker process."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds the ids of each text: ``array<int>``."""
    schema = docs.drop(ids_col).withColumn(ids_col, F.array(F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in common.slices(batches):
            ids = [x.astype(np.int32) for x in bpe.encode_all(batch.column(batch.schema.get_field_index(text_col)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, ids_col])

    return docs.drop(ids_col).mapInArrow(common.tidy(run), schema.schema)


def decode(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds the decoded text of each array of ids; null ids decode to the empty text."""
    schema = docs.drop(text_col).withColumn(text_col, F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in common.slices(batches):
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            texts = [bpe.decode(np.array(i or [], "<u4").tobytes()).decode() for i in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    return docs.drop(text_col).mapInArrow(common.tidy(run), schema.schema)


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, decodes and keeps digests alone: ``(id, n_tokens, ids_sha256, decoded_sha256)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in common.slices(batches, 2048):
            n, a, b = [], [], []
            for ids, cuts in bpe.encode_blocks(batch.column(1)):
                n += np.diff(cuts).tolist()
                a += [hashlib.sha256(ids[x:y].astype("<u4").tobytes()).hexdigest() for x, y in zip(cuts, cuts[1:], strict=False)]
                b += [hashlib.sha256(text).hexdigest() for text in bpe.decode_block(ids, cuts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(common.tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
