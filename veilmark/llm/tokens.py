"""Whole texts to token ids with a public tokenizer file, word by word through a bounded cache.

A byte-pair tokenizer never merges across the borders of its pre-tokenizer, so a text may be
cut at such borders, each piece encoded on its own and the ids joined.  Prose repeats its
words, so most pieces are found in a dictionary and the library only sees new ones.  Texts are
cut, pieces numbered and ids joined a batch at a time by Arrow; Python sees each piece once a batch.

Where the file's own pre-tokenizer is one of those below, a new piece of letters, punctuation and
single line breaks is cut once more, so that ``Word.``, ``word,`` and ``word`` share their letters;
the letters that are new are encoded together and told apart by the tokens that begin or end a word.
"""

from __future__ import annotations

import functools
import json
import os
import re
import string
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 0
#: Pieces a worker remembers; a word stands for all its pieces with marks.
KEEP = 500_000
#: Runs of punctuation a worker remembers.
RUNS_KEPT = 10_000
_BEFORE_WORD = re.compile(r" (?=[^\s\x1c-\x1f])")
#: A space that no word follows, for Arrow, whose patterns cannot look ahead.
_ODD_SPACE = r" (?:[\s\x0B\x1c-\x1f\x{85}]|\pZ|\z)"


def byte_level_pieces(texts: pa.Array) -> pa.Array:
    """Cut before each space that a non-space follows: a byte-level pre-tokenizer always does so.

    All pieces but the first of a text have lost that space.
    """
    if pc.any(pc.match_substring_regex(texts, _ODD_SPACE)).as_py():
        return pa.array([_BEFORE_WORD.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    return pc.split_pattern(texts, " ")


def word_level_pieces(texts: pa.Array) -> pa.Array:
    """Cut at ASCII white space, which a word-level pre-tokenizer drops."""
    return pc.ascii_split_whitespace(texts)


#: How to cut, and what stood before all pieces but the first.
PIECES: dict[str, tuple[Callable[[pa.Array], pa.Array], str]] = {
    "byte": (byte_level_pieces, " "),
    "word": (word_level_pieces, ""),
}

# Letters and punctuation that every version of Unicode and each normal form leaves alone; no apostrophe,
# as contractions begin with it.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = string.punctuation.replace("'", "")
_RUN = f"[{re.escape(_MARKS)}]"
_WORD = re.compile(f"[{_LETTERS}]+")
_LINES = re.compile(rf"[{_LETTERS}]+{_RUN}*(?:\n[{_LETTERS}]+{_RUN}*)*")
_PARTS = re.compile(rf"\n?[{_LETTERS}]+|{_RUN}+")
#: What could stand inside a piece that :data:`_LINES` matches.
_INSIDE = re.compile(rf"[{_LETTERS}]*{_RUN}*(?:\n[{_LETTERS}]*{_RUN}*)*")
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _finer(spec: dict, kind: str) -> bool:
    """Whether the pre-tokenizer of the file *spec* always parts letters, punctuation and single line breaks."""
    before, normal = spec["pre_tokenizer"] or {}, spec["normalizer"]
    if any(_INSIDE.fullmatch(t["content"]) for t in spec["added_tokens"]):
        return False
    if kind == "byte":
        return normal is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
    steps = before.get("pretokenizers", [])
    steps = [(s["type"], s.get("pattern"), s.get("invert"), s.get("use_regex"), s.get("add_prefix_space")) for s in steps]
    normal = [(n["type"], n.get("pattern"), n.get("content")) for n in (normal or {}).get("normalizers", [])]
    return (
        steps == [("Split", {"Regex": _WORD_SPLIT}, True, None, None), ("ByteLevel", None, None, False, False)]
        and normal == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and spec["model"].get("end_of_word_suffix") == "</w>"
    )


class Encoder:
    """Encodes texts to little-endian 32-bit ids.

    *kind* names how pieces are cut: ``byte`` for byte-level files, ``word`` for files that
    drop white space.  Up to *keep* short pieces are remembered; when many new pieces come up
    after that (other languages, other sources), the memory starts anew.
    """

    def __init__(self, path: str, kind: str, keep: int = KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = kind
        self.pieces, self.before = PIECES[kind]
        self.keep = keep
        #: Ids of pieces; a key that begins with a line break has no space before it.
        self.known: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.finer = _finer(json.loads(self.tokenizer.to_str()), kind)
        vocabulary = self.tokenizer.get_vocab()
        #: Tokens that begin a word (byte), or that end one.
        self.edges = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self.edges[i] = token.startswith(("Ġ", "Ċ")) if kind == "byte" else token.endswith("</w>")

    def _encode(self, pieces: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """Ids of *words* of letters, encoded as one text."""
        if self.kind == "byte":
            text = "".join(w if w[0] == "\n" else self.before + w for w in words)
        else:
            text = " ".join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        edges = np.flatnonzero(self.edges[ids])
        if len(edges) != len(words):
            return self._encode([w if w[0] == "\n" else self.before + w for w in words])
        cuts = [*edges.tolist(), len(ids)] if self.kind == "byte" else [0, *(edges + 1).tolist()]
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]

    def _fresh(self, new: list[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Ids to remember, and ids of pieces that are put together again each time; both have all of *new*."""
        if not self.finer:
            return dict(zip(new, self._encode([self.before + p for p in new]))), {}
        lower = self.kind == "word"
        bare, marked, lined, whole = [], [], [], []
        for p in new:
            word = p.rstrip(_MARKS)
            if word.isalpha() and (word.isascii() or _WORD.fullmatch(word)):
                if len(word) == len(p):
                    bare.append(p)
                else:
                    marked.append((p, word, p[len(word) :]))
            elif _LINES.fullmatch(p):
                lined.append((p, _PARTS.findall(p)))
            else:
                whole.append(p)
        pieces, words, tails = zip(*marked) if marked else ((), (), ())
        parts = [x for _, xs in lined for x in xs]
        words = [*bare, *words, *(x for x in parts if x[-1] not in _MARKS)]
        if lower:
            words = list(map(str.lower, words))
        letters = list(set(words).difference(self.known))
        fresh = dict(zip(letters, self._encode_letters(letters))) if letters else {}
        ids = [fresh.get(w) or self.known[w] for w in words]

        runs = {*tails, *(x for x in parts if x[-1] in _MARKS)}
        run_ids = {x: self.runs[x] for x in runs if x in self.runs}
        unseen = list(runs.difference(run_ids))
        run_ids.update(zip(unseen, self._encode(unseen)))
        if len(self.runs) < RUNS_KEPT:
            self.runs.update((x, run_ids[x]) for x in unseen if len(x) <= 64)

        joined = dict(zip(bare, ids)) if lower else {}
        rest = iter(ids[len(bare) :])
        joined.update((p, i + run_ids[t]) for p, t, i in zip(pieces, tails, rest))
        joined.update((p, b"".join([run_ids[x] if x[-1] in _MARKS else next(rest) for x in xs])) for p, xs in lined)
        fresh.update(zip(whole, self._encode([self.before + p for p in whole])))
        return fresh, joined

    def __call__(self, texts: Iterable[str | None]) -> list[bytes]:
        cut = self.pieces(pa.array([t or "" for t in texts], pa.string()))
        if not len(cut):
            return []
        coded = cut.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids: list[bytes | None] = list(map(self.known.get, pieces))
        if None in ids:
            new = [p for p, i in zip(pieces, ids) if i is None]
            fresh, joined = self._fresh(new)
            ids = [joined.get(p) or fresh[p] if i is None else i for p, i in zip(pieces, ids)]
            if len(self.known) >= self.keep and len(fresh) * 4 > len(coded):
                self.known = {}
            if len(self.known) < self.keep:
                self.known.update((p, i) for p, i in fresh.items() if len(p) <= 64)
        spread = pa.array(ids, pa.large_binary()).take(coded.indices)
        at = np.frombuffer(spread.buffers()[1], np.int64)[spread.offset :]
        raw = memoryview(spread.buffers()[2] or b"")
        ends = cut.offsets.to_numpy()
        if not self.before:
            return [raw[at[a] : at[b]].tobytes() for a, b in zip(ends, ends[1:])]
        # The first piece of a text has no space before it.
        firsts = self._encode([pieces[k] for k in coded.indices.to_numpy()[ends[:-1]]])
        return [first + raw[at[a + 1] : at[b]].tobytes() for first, a, b in zip(firsts, ends, ends[1:])]


@functools.lru_cache(maxsize=2)
def encoder(path: str, kind: str, keep: int = KEEP) -> Encoder:
    """One encoder per worker and file, which remembers *keep* pieces (about 250 bytes each)."""
    return Encoder(path, kind, keep)
