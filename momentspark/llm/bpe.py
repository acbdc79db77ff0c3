"""Byte-level BPE encoding and decoding (dealt operator 5), with the tokenizers library over Arrow batches.

The byte table of byte-level BPE names each of the 256 bytes by a printable character; a token's bytes are
its characters looked up backwards. A space before a character that is no white space always starts a new match of the
split pattern, which makes the pieces between such spaces independent of each other. So a batch of texts is split at its spaces
in Arrow, each distinct piece is encoded once (workers keep the ids of words from batch to batch), and the ids
of all pieces are taken from those of the distinct ones. Texts with other white space after a space are split one by one, and those that
hold an added token of the definition go to the tokenizer whole.
"""

from __future__ import annotations

import base64
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices


def byte_characters() -> list[str]:
    """The printable character of each byte: itself if it is a visible Latin-1 one, else the next from U+0100 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b <= 0xFF and b != 0xAD)]
    names = {b: chr(b) for b in visible}
    for b in range(256):
        names.setdefault(b, chr(256 + len(names) - len(visible)))
    return [names[b] for b in range(256)]


CHARS = byte_characters()
BYTES = {c: b for b, c in enumerate(CHARS)}
#: A word and the signs after it, each of which is one match of the split pattern (no apostrophe: it may start one).
WORDS = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@[-`{-~]*)")
SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
GAP = re.compile(r" (?=\S)")
#: A space before other white space or at the end of a text.
NOT_PLAIN = r" (?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|\z)"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its rank, which is its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """In the order of their ranks, the pairs that make the tokens of two bytes or more.

    A token's last merge joins the two parts that merging by the lower ranks alone leaves of it.
    """
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if best[0] >= rank:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizers definition that splits by `pattern` and merges each match by `ranks`."""
    name = lambda b: "".join(CHARS[x] for x in b)
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True, "vocab": {name(t): r for t, r in ranks.items()}, "merges": [[name(a), name(b)] for a, b in merges_of(ranks)]}
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, level]}, "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}, "model": model})


class Encoder:
    """Ids of whole texts by a tokenizers definition (byte-level BPE, GPT-2's split pattern), as `Tokenizer.encode` gives them without
    its post-processor: added tokens that stand in a text become their ids."""

    def __init__(self, definition: str, most_pieces: int = 300_000, longest_kept: int = 100):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_str(definition)
        known = json.loads(definition)
        parts = known["model"]
        # the pieces are kept here, so the model need not keep them too
        self.model = BPE(vocab=parts["vocab"], merges=[tuple(m.split(" ") if isinstance(m, str) else m) for m in parts["merges"]], cache_capacity=0, ignore_merges=bool(parts.get("ignore_merges")))
        special = {t["content"]: t["id"] for t in known.get("added_tokens") or []}
        self.tokens = [b""] * (max([*parts["vocab"].values(), *special.values()], default=-1) + 1)
        for token, i in parts["vocab"].items():
            self.tokens[i] = bytes(BYTES.get(c, 0) for c in token)
        for token, i in special.items():
            self.tokens[i] = token.encode()
        added = "|".join(map(re.escape, special))
        self.added = re.compile(added) if added else None
        self.unlike = NOT_PLAIN + ("|" + added if added else "")
        encoder = self

        class Words(dict):
            """Ids of pieces by text. What a word is made of is kept here, what is made of words is not."""

            def __init__(self, before: str):
                self.before = before

            def __missing__(self, word: str) -> bytes:
                letters = word.rstrip(SIGNS)
                known = self.get(letters) if letters != word else None
                if known is not None:
                    return known + encoder.bare[word[len(letters) :]]
                m = WORDS.fullmatch(word)
                if m and m[2]:
                    return self[m[1]] + encoder.bare[m[2]]
                if not m:
                    return encoder._lines(self, word)
                if len(self) >= most_pieces:
                    self.clear()
                ids = encoder._match(self.before + word)
                if len(word) <= longest_kept:
                    self[word] = ids
                return ids

        class Signs(dict):
            def __missing__(self, signs: str) -> bytes:
                if len(self) >= most_pieces:
                    self.clear()
                ids = encoder._match(signs)
                if len(signs) <= longest_kept:
                    self[signs] = ids
                return ids

        self.spaced, self.unspaced, self.bare = Words(" "), Words(""), Signs()

    def _match(self, text: str) -> bytes:
        """One match of the split pattern: a word or signs, with the space before it if it has one."""
        named = text.replace(" ", CHARS[32]) if text.isascii() and text != "\n" else "".join([CHARS[b] for b in text.encode()])
        return array("I", [t.id for t in self.model.tokenize(named)]).tobytes()

    def _lines(self, words: dict, piece: str) -> bytes:
        """A piece that is no plain word: words with line feeds between them, or anything."""
        parts = piece.split("\n")
        if not all(map(WORDS.fullmatch, parts)):
            return self._whole(words.before + piece)
        feed = self.bare["\n"]
        return feed.join([words[parts[0]], *map(self.unspaced.__getitem__, parts[1:])])

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Of one text, as little-endian unsigned 32-bit integers."""
        if self.added and self.added.search(text):
            return self._whole(text)
        first, *rest = GAP.split(text)
        start = self.unspaced[first] if first else b""
        return start + b"".join(map(self.spaced.__getitem__, rest))

    def lists(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of a batch of texts (null: empty): all ids in order (int32) and where each text starts among them, with the end (int64)."""
        texts = pc.fill_null(texts, "")
        unlike = pc.match_substring_regex(texts, self.unlike).to_numpy(zero_copy_only=False)
        if not unlike.any():
            return self._plain(texts)
        ids, at = self._plain(texts.filter(pa.array(~unlike)))
        rest = iter(np.split(ids, at[1:-1]) if len(at) > 1 else [])
        out = [np.frombuffer(self.ids(text), dtype="<i4") if x else next(rest) for x, text in zip(unlike, texts.to_pylist(), strict=True)]
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts in which every space stands before a character that is no white space."""
        if not len(texts):
            return np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        split = pc.split_pattern(texts, " ")
        pieces, at = split.flatten(), split.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        distinct = pieces.dictionary_encode()
        found = list(map(self.spaced.__getitem__, distinct.dictionary.to_numpy(zero_copy_only=False)))
        code = distinct.indices.to_numpy().astype(np.int64)
        code[at[:-1]] = len(found) + np.arange(len(texts))  # a text's first piece has no space before it
        found += [self.unspaced[p] if p else b"" for p in pieces.take(pa.array(at[:-1])).to_numpy(zero_copy_only=False)]
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        each = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]), np.frombuffer(b"".join(found), dtype="<i4"))
        taken = each.take(pa.array(code))
        return taken.values.to_numpy()[: taken.offsets[-1].as_py()], taken.offsets.to_numpy()[at]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids; an added token's are those of its text."""
        return b"".join([self.tokens[i] for i in ids])


def character_offsets(lengths: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of tokens with these byte lengths over `data` (UTF-8): first character (index) and end, exclusive.

    A token that holds only part of a character gets that whole character, so neighbours may overlap there.
    """
    heads = np.frombuffer(data, dtype=np.uint8) & 0xC0 != 0x80
    count = np.concatenate([[0], np.cumsum(heads)])  # characters that began before each byte
    ends = np.cumsum(lengths)
    starts = ends - lengths
    first = count[np.minimum(starts + 1, len(heads))] - 1
    return np.where(lengths > 0, np.maximum(first, 0), count[starts]), count[ends]


def decode_text(parts: list[bytes]) -> list[str]:
    """The text that each token completes: a character split over tokens comes with the last of them, and
    bytes that are no UTF-8 become U+FFFD."""
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")(errors="replace")
    return [decoder.decode(p, final=i == len(parts) - 1) for i, p in enumerate(parts)]


_encoders: dict[str, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """Of this worker; kept from task to task."""
    if definition not in _encoders:
        _encoders.clear()
        _encoders[definition] = Encoder(definition)
    return _encoders[definition]


def encode(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """(id_col, ids array<int>) for each row, with `offsets` also char_start and char_end array<int> by token.

    Null and empty texts have no ids. Rows with a null or repeated id keep theirs; other columns are ignored.
    `definition` (the tokenizers JSON) is bounded by the vocabulary, and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches):
        enc = encoder(shared.value)
        size = np.array([len(t) for t in enc.tokens], dtype=np.int64)
        for b in slices(batches, "t"):
            ids, at = enc.lists(b.column("t"))
            lists = lambda values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))  # noqa: B023, E731
            cols = [b.column("i"), lists(ids)]
            if offsets:
                spans = [character_offsets(size[i], (t or "").encode()) for i, t in zip(np.split(ids, at[1:-1]), b.column("t").to_pylist(), strict=True)]
                cols += [lists(np.concatenate([s[k] for s in spans])) for k in (0, 1)]
            yield pa.record_batch(cols, names=["i", "ids", "char_start", "char_end"][: len(cols)])

    slim = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    more = ", char_start array<int>, char_end array<int>" if offsets else ""
    return slim.mapInArrow(run, f"i {slim.schema['i'].dataType.simpleString()}, ids array<int>{more}").withColumnRenamed("i", id_col)


def decode(encoded: DataFrame, definition: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, bytes binary, text string): what ids stand for; null ids give null, no ids give an empty value."""
    shared = encoded.sparkSession.sparkContext.broadcast(definition)

    def run(batches):
        enc = encoder(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                s = b.slice(at, 500)
                data = [None if i is None else enc.decode(i) for i in s.column("ids").to_pylist()]
                yield pa.record_batch([s.column("i"), pa.array(data, type=pa.binary()), pa.array([None if d is None else d.decode("utf-8", "replace") for d in data], type=pa.string())], names=["i", "bytes", "text"])

    slim = encoded.select(F.col(id_col).alias("i"), F.col(ids_col).alias("ids"))
    return slim.mapInArrow(run, f"i {slim.schema['i'].dataType.simpleString()}, bytes binary, text string").withColumnRenamed("i", id_col)


def round_trip(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass: (id_col, n_tokens, ids_sha256, decoded_sha256, n_split long).

    n_split counts the tokens that end inside a character. Null and empty texts have no tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches):
        from hashlib import sha256

        enc = encoder(shared.value)
        tokens = pa.array(enc.tokens, pa.large_binary())
        for b in slices(batches, "t"):
            ids, at = enc.lists(b.column("t"))
            taken = tokens.take(pa.array(ids))
            ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, dtype=np.int64)
            packed, data = memoryview(ids.tobytes()), memoryview(taken.buffers()[2] if len(ids) else b"")
            inside = np.append(np.frombuffer(data, dtype=np.uint8)[: ends[-1]] & 0xC0 == 0x80, False)[ends[1:]]
            split = np.diff(np.concatenate([[0], np.cumsum(inside)])[at])  # texts end with a whole character
            n, rows = np.diff(at), list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            digest = [sha256(packed[4 * a : 4 * z]).hexdigest() for a, z in rows]
            decoded = [sha256(data[ends[a] : ends[z]]).hexdigest() for a, z in rows]
            yield pa.record_batch([b.column("i"), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string()), pa.array(split, pa.int64())], names=["i", "n_tokens", "ids_sha256", "decoded_sha256", "n_split"])

    slim = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return slim.mapInArrow(run, f"i {slim.schema['i'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long").withColumnRenamed("i", id_col)
