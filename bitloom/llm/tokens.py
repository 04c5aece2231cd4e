"""Token ids of whole texts with a public tokenizer file, vectorised over distinct words.

The tokenizer drops white space and never joins across it, so the ids of a text are those of its
white-space-separated chunks in order. Each Arrow batch is split and dictionary-encoded, only
chunks not seen before are given to the tokenizers library, and ids are gathered with numpy.
:func:`for_chunks` refuses a tokenizer file for which that does not hold.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import AT_STAGE_START


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Chunks remembered per process; beyond it the older half is forgotten (a cache, not a cap).
KNOWN_LIMIT = 300000


class ChunkTokenizer:
    """Encodes string arrays; remembers the ids of chunks it has seen."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        split = [s for s in spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]]) if s["type"] == "Split"]
        if not any(s["behavior"] == "Removed" and s["invert"] for s in split):
            raise ValueError(f"{path}: white space is part of tokens, so texts can't be encoded by chunks")
        self.special = [t["content"] for t in spec["added_tokens"]]
        normal = spec["normalizer"].get("normalizers", [spec["normalizer"]]) if spec["normalizer"] else []
        self.lowers = any(n["type"] == "Lowercase" for n in normal)
        suffix = spec["model"].get("end_of_word_suffix")
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.words = pa.array([], pa.string())
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)

    def _encode_lists(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Add new chunks. Chunks of letters are one word each, so many are encoded as one text and cut at word ends. Returns the order in which they were added."""
        letters = pc.match_substring_regex(words, r"^\pL+$").to_numpy(zero_copy_only=False)
        listed = words.to_pylist()
        plain = np.flatnonzero(letters).tolist()
        sizes = np.zeros(len(listed), np.int64)
        runs: list[tuple[list[int], np.ndarray]] = []
        odd = np.flatnonzero(~letters).tolist()
        groups = [plain[i : i + 512] for i in range(0, len(plain), 512)]
        for group, ids in zip(groups, self._encode_lists([" ".join(listed[i] for i in g) for g in groups]), strict=True):
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) != len(group):  # some letter is taken apart by normalisation
                odd += group
                continue
            sizes[group] = np.diff(ends, prepend=-1)
            runs.append((group, ids))
        for i, ids in zip(odd, self._encode_lists([listed[i] for i in odd]), strict=True):
            sizes[i] = len(ids)
            runs.append(([i], ids))
        order = np.array([i for g, _ in runs for i in g], np.int64)
        self.words = pa.concat_arrays([self.words, words.take(pa.array(order))])
        self.ids = np.concatenate([self.ids, *(ids for _, ids in runs)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes[order])])
        return order

    def _forget(self) -> None:
        k = max(0, len(self.words) - KNOWN_LIMIT // 2)
        self.words = pa.concat_arrays([self.words.slice(k)])
        self.ids = self.ids[self.at[k] :].copy()
        self.at = self.at[k:] - self.at[k]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat uint32 ids and the n + 1 offsets of each text (null: empty)."""
        texts = texts.cast(pa.string())
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        if self.lowers and not any(pc.any(pc.match_substring(texts, t, ignore_case=True)).as_py() for t in self.special):
            # ASCII case is folded anyway, and a full stop or comma after a letter is a word of its own
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), "([a-z])([.,])", "\\1 \\2")
        chunks = pc.ascii_split_whitespace(texts)
        coded = chunks.flatten().dictionary_encode()
        where = pc.index_in(coded.dictionary, value_set=self.words)
        if where.null_count and len(self.words) + where.null_count > KNOWN_LIMIT:
            self._forget()
            where = pc.index_in(coded.dictionary, value_set=self.words)
        place = pc.fill_null(where, -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            known = len(self.words)
            order = self._learn(coded.dictionary.take(pa.array(new)))
            place[new[order]] = known + np.arange(len(new))
        entry = place[coded.indices.to_numpy()]
        size = self.at[entry + 1] - self.at[entry]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        ids = self.ids[np.repeat(self.at[entry] - (end - size), size) + np.arange(total)]
        off = np.frombuffer(chunks.buffers()[1], np.int32, len(chunks) + 1, chunks.offset * 4).astype(np.int64)
        return ids, np.concatenate(([0], end))[off - off[0]]


_OPEN: dict[str, ChunkTokenizer] = {}
AT_STAGE_START.append(_OPEN.clear)


def for_chunks(path: str) -> ChunkTokenizer:
    """One tokenizer per process, stage and file."""
    if path not in _OPEN:
        _OPEN[path] = ChunkTokenizer(path)
    return _OPEN[path]


def with_end(ids: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with ``end_id`` after each."""
    n = len(off) - 1
    return np.insert(ids, off[1:], np.uint32(end_id)).astype(np.uint32), off + np.arange(n + 1)
