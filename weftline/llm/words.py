"""Words of Arrow texts: runs without ASCII white space, once each, with the places they take."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Words:
    """Distinct words of a batch (``unique``), the code of every word in order, and the row it belongs to."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pa.array(texts.fill_null(""), pa.large_string()))
        counts = np.diff(lists.offsets.to_numpy())
        coded = lists.flatten().dictionary_encode()
        self.unique = coded.dictionary
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.repeat(np.arange(len(texts)), counts)
        empty = pc.equal(pc.binary_length(self.unique), 0).to_numpy(zero_copy_only=False)
        if empty.any():
            real = ~empty[codes]
            codes, rows = codes[real], rows[real]
        self.codes, self.rows, self.n = codes, rows, len(texts)
        self.counts = np.bincount(rows, minlength=len(texts))

    def total(self, per_word: np.ndarray) -> np.ndarray:
        """Sum of a number of each distinct word over the words of every row."""
        return np.bincount(self.rows, weights=per_word[self.codes], minlength=self.n)
