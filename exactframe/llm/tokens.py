"""Token ids of whole texts by an existing word tokenizer, with caches of words per Python worker.

The tokenizer drops white space and never joins across it, so a text's ids are those of its words in order. Words
seen before cost one lookup. New words are cut into runs of letters, digits and marks as the tokenizer does; new runs
go to the tokenizer, many at a time. Words with anything unusual go there whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries in the caches of words and of runs; a full cache is emptied.
WORDS, RUNS = 250_000, 350_000
_LETTER = "a-zß-öø-įı-ſ"
#: What the tokenizer's own pattern does on ordinary Latin text, in lower case.
_RUN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|\\n|[^{_LETTER}0-9\\n]+")
_ODD = re.compile("[^\n\x21-\x7eÀ-ÖØ-öø-įı-ſ]|<\\|")
#: Between words; no two ids in a row look like it, as they are below 2 ** 16.
_CUT = b"\xff\xff\xff\xff"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class WordTokenizer:
    """``ids(texts)``: for each text its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        # the same merges alone, for runs whose bytes are written as the vocabulary writes them
        bare = json.loads(Path(path).read_text()) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.merges = Tokenizer.from_str(json.dumps(bare))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.written = dict(zip(plain, map(chr, plain), strict=True))
        self.written |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in self.written)} | {10: " "}
        self.words: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def ids(self, texts: list[bytes]) -> list[bytes]:
        # lower case comes first anyway; control strings are told by case
        low = pa.array([t if b"<|" in t else t.translate(_LOWER) for t in texts], pa.binary())
        cut = pc.ascii_split_whitespace(low.view(pa.string()))
        # a word is looked up once for all its places in these texts
        coded = cut.flatten().view(pa.binary()).dictionary_encode()
        found = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), b"\n")[0].as_py().split(b"\n")
        if len(self.words) > WORDS:
            self.words.clear()
        have = list(map(self.words.get, found))
        new = [w for w, x in zip(found, have, strict=False) if x is None and w]
        if new:
            self._learn(new)
            have = [x if x is not None else self.words.get(w, b"") for w, x in zip(found, have, strict=True)]
        else:
            have = [x or b"" for x in have]
        each = pa.array(have, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(each.buffers()[1], np.int64, len(each) + 1, 8 * each.offset)[cut.offsets.to_numpy()].tolist()
        data = memoryview(each.buffers()[2] or b"")
        return [bytes(data[lo:hi]) for lo, hi in zip(ends, ends[1:], strict=False)]

    def _learn(self, new: list[bytes]) -> None:
        if len(self.runs) > RUNS:
            self.runs.clear()
        text = b"\n".join(new).decode("utf-8", "replace")
        if _ODD.search(text):
            odd = [w for w in new if _ODD.search(w.decode("utf-8", "replace"))]
            for w, e in zip(odd, self.whole.encode_batch([w.decode("utf-8", "replace") for w in odd], add_special_tokens=False), strict=True):
                self.words[w] = np.array(e.ids, "<u4").tobytes()
            new = list(set(new).difference(odd))
            text = b"\n".join(new).decode()
        if new:
            cut = _RUN.findall(text.lower())
            self._learn_runs(list(set(cut).difference(self.runs, "\n")))
            self.runs["\n"] = _CUT
            self.words.update(zip(new, b"".join(map(self.runs.__getitem__, cut)).split(_CUT), strict=True))

    def _learn_runs(self, runs: list[str]) -> None:
        for k in range(0, len(runs), 2000):
            part = runs[k : k + 2000]
            text = "\n".join(part).encode().decode("latin-1").translate(self.written)
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) == len(part):
                raw, lo = ids.tobytes(), 0
                for r, hi in zip(part, stops.tolist(), strict=True):
                    self.runs[r] = raw[lo:hi]
                    lo = hi
            else:  # a run that is cut otherwise than expected: each by itself
                for r, e in zip(part, self.whole.encode_batch(part, add_special_tokens=False), strict=True):
                    self.runs[r] = np.array(e.ids, "<u4").tobytes()


@lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
