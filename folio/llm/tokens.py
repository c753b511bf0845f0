"""Fast exact encoding with the tokenizers library: each distinct space-delimited piece is encoded once.

A pre-tokenizer that never joins characters across a change from non-space to space gives the same ids for a
whole text as for its pieces one after another. Both public tokenizers are of that kind, so a worker keeps a
bounded table piece -> ids and gathers whole texts from it with Arrow and numpy. Where pieces carry their
leading space, texts with runs of white space or white space beyond blank and newline are encoded whole. So are
texts that hold the string of an added token, for which the library's plain call gives that token's id, and all
texts where the vocabulary file states another normaliser or pre-tokenizer than those that this relies on.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from folio.llm import common

#: White space other than single inner blanks and newlines.
IRREGULAR = "[\\x00\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]|[ \\n][ \\n]|\\A[ \\n]|[ \\n]\\z"
#: A run of signs between a letter and white space or the end: a token boundary for both pre-tokenizers. The
#: apostrophe is left out, as contractions begin with it, and letters beyond Latin-1, as some of them end in a mark,
#: which joins the signs, once composed or in lower case.
SIGNS = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])([!-&(-/:-@\[-`{-~]+)([ \n]|\z)"
#: Marks after which lower-casing a letter alone could change how they compose.
MARKS = r"[\x{300}-\x{36f}]"
#: Pieces that byte-level BPE cuts into a word and a run of signs, with no contraction in them.
_PLAIN = re.compile(r"( ?)([A-Za-z]+)([^A-Za-z0-9\s']*)", re.ASCII)


#: Normaliser and pre-tokenizer of the two kinds of files whose texts may be cut into pieces, by `spaced`.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_RELIED_ON = {
    True: (None, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}),
    False: (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]},
    ),
}


class _Index(dict):
    """piece -> row of the table; unknown pieces get the next row and wait in `new` as the library shall see them."""

    def __init__(self, new: list[str]):
        super().__init__()
        self.new = new

    def __missing__(self, piece: str) -> int:
        self[piece] = row = len(self.new)
        self.new.append(self.seen(piece))
        return row

    def seen(self, piece: str) -> str:
        return piece


class _LedIndex(_Index):
    """Pieces that follow a blank, which the split has taken. Signs cut off the letter before them stand behind
    U+0000: texts that hold one themselves are encoded whole, so no piece begins with it otherwise."""

    def seen(self, piece: str) -> str:
        return piece[1:] if piece[:1] == "\0" else piece if piece[:1] == "\n" else " " + piece


def _untrimmed(spec):
    """A part of a vocabulary file without the settings that only move offsets."""
    if isinstance(spec, dict):
        return {k: _untrimmed(v) for k, v in spec.items() if k != "trim_offsets"}
    return [_untrimmed(x) for x in spec] if isinstance(spec, list) else spec


class PieceEncoder:
    """encode(texts) -> (ids, offsets). `spaced`: pieces keep their leading white space (byte-level BPE).

    `literal`: strings of added tokens in a text are ordinary text; otherwise they have the added token's id, as
    the library gives it."""

    def __init__(self, path: str, spaced: bool, literal: bool = False, max_pieces: int = 1_000_000, max_piece_bytes: int = 32_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.spaced, self.literal, self.max_pieces, self.max_piece_bytes = spaced, literal, max_pieces, max_piece_bytes
        self.cuts = True  # whether texts may be cut into pieces
        self.added = ""  # pattern of texts that hold an added token
        self._load(path)
        self._reset()

    def _load(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = self.literal
        model, added = self.tokenizer.model, list(self.tokenizer.get_added_tokens_decoder().values())
        parts = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        # the parts state themselves; the file as a whole would be tens of MB of objects in every worker
        stated = tuple(_untrimmed(json.loads(p.__getstate__())) if p is not None else None for p in parts)
        self.cuts = (
            stated == _RELIED_ON[self.spaced]
            and type(model).__name__ == "BPE"
            and not any(getattr(model, k) for k in ("dropout", "continuing_subword_prefix"))
            and not any(getattr(self.tokenizer, k) for k in ("truncation", "padding"))
            and not any(t.normalized or self.literal and not t.special for t in added)
        )
        if not self.literal:
            self.added = "|".join(re.escape(t.content) for t in added)

    def _reset(self) -> None:
        self.pieces: list[str] = []  # by row; those from `known` on are not encoded yet
        self.known = self.key_bytes = 0
        self.index = _LedIndex(self.pieces) if self.spaced else _Index(self.pieces)
        self.first = _Index(self.pieces)  # pieces that begin a text
        self.lens, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int32)  # the table is far below 2 GB
        self.arena = np.zeros(0, np.uint32)

    def _codes(self, pieces: list[str]) -> list[list[int]]:
        if not self.spaced:
            return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        model, out, rest = self.tokenizer.model, [], []
        for k, piece in enumerate(pieces):
            m = _PLAIN.fullmatch(piece) if piece.isascii() else None
            if m:
                ids = [t.id for t in model.tokenize(("Ġ" if m[1] else "") + m[2])]
                out.append(ids + [t.id for t in model.tokenize(m[3])] if m[3] else ids)
            else:
                out.append(None)
                rest.append(k)
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def _learn(self) -> None:
        new = self.pieces[self.known :]
        if not new:
            return
        self.known = len(self.pieces)
        for k in range(self.known - len(new), self.known):
            self.pieces[k] = ""
        coded = self._codes(new)
        lens = np.fromiter(map(len, coded), np.int32, len(coded))
        ids = np.fromiter(chain.from_iterable(coded), np.uint32, int(lens.sum()))
        self.starts = np.concatenate([self.starts, (len(self.arena) + np.cumsum(lens) - lens).astype(np.int32)])
        self.lens = np.concatenate([self.lens, lens])
        self.arena = np.concatenate([self.arena, ids])
        self.key_bytes += sum(map(len, new))

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
        """Which texts must be encoded whole, and the pieces of the others."""
        odd = np.full(len(texts), not self.cuts)
        for pattern in filter(None, (self.added, IRREGULAR if self.spaced else "")):
            odd = odd | pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
        if odd.any():
            texts = texts.filter(pa.array(~odd))
        if self.spaced:
            regular = pc.replace_substring_regex(texts, SIGNS, "\\1 \0\\2\\3")
            return odd, pc.split_pattern(pc.replace_substring(regular, "\n", " \n"), " ")
        texts = pc.replace_substring_regex(texts, SIGNS, r"\1 \2\3")
        if not pc.any(pc.match_substring_regex(texts, MARKS)).as_py():
            texts = pc.ascii_lower(texts)  # the vocabulary has no capitals
        return odd, pc.ascii_split_whitespace(texts)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (uint32), and int64 offsets, one more than texts. No text is null."""
        if self.known > self.max_pieces or self.key_bytes > self.max_piece_bytes:
            self._reset()
        n = len(texts)
        odd, lists = self._split(texts)
        at = lists.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        coded = lists.flatten().dictionary_encode()
        table = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy()
        row = np.fromiter(map(self.index.__getitem__, table), np.int32, len(table))[codes] if len(codes) else np.zeros(0, np.int32)
        if self.spaced and len(codes):
            row[at[:-1]] = [self.first[table[c]] for c in codes[at[:-1]].tolist()]
        self._learn()
        lens = self.lens[row]
        ends = np.cumsum(lens, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        place = np.int32 if total < 1 << 31 else np.int64
        step = np.repeat((self.starts[row] - (ends - lens)).astype(place), lens)
        step += np.arange(total, dtype=place)
        ids = self.arena[step]
        offsets = np.concatenate([[0], ends])[at]
        if odd.any():
            parts, k = [], 0
            for i in range(n):
                if odd[i]:
                    parts.append(np.asarray(self._whole(texts[i].as_py()), np.uint32))
                else:
                    parts.append(ids[offsets[k] : offsets[k + 1]])
                    k += 1
            ids = np.concatenate(parts)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, offsets


_encoders: dict[tuple[str, bool, bool], PieceEncoder] = {}
common.worker_caches.append(_encoders)


def encoder(path: str, spaced: bool, kind: type[PieceEncoder] = PieceEncoder, literal: bool = False) -> PieceEncoder:
    """One encoder for each worker process and vocabulary."""
    if (path, spaced, literal) not in _encoders:
        _encoders[path, spaced, literal] = kind(path, spaced, literal)
    return _encoders[path, spaced, literal]
