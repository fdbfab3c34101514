"""Terms of texts: runs of digits, ASCII letters (lowered) and characters beyond ASCII, as packs of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from recordloom.llm.text_arrays import Pack, pack, raw_bytes

#: What a byte becomes: all bytes of characters beyond ASCII stay, A-Z are lowered, other ASCII is a blank.
_BYTE = np.full(256, 0x20, dtype=np.uint8)
_BYTE[0x30:0x3A] = np.arange(0x30, 0x3A)
_BYTE[0x41:0x5B] = np.arange(0x61, 0x7B)
_BYTE[0x61:0x7B] = np.arange(0x61, 0x7B)
_BYTE[0x80:] = np.arange(0x80, 0x100)


def term_pack(texts: pa.Array) -> Pack:
    """One row per text; its words are the maximal runs of term characters. Null has none."""
    data, offsets = raw_bytes(texts)
    return pack(_BYTE[data], offsets)


def line_pack(texts: pa.Array) -> tuple[Pack, np.ndarray]:
    """One row per line that has a term, and the text of each row; lines are cut at newlines."""
    data, offsets = raw_bytes(texts)
    ends = np.flatnonzero(data == 0x0A) + 1
    cuts = np.unique(np.concatenate([offsets, ends]))
    text = np.searchsorted(offsets, cuts[:-1], side="right") - 1
    lines = pack(_BYTE[data], cuts)
    filled = lines.n_words > 0
    first = np.concatenate([lines.first[:-1][filled], lines.first[-1:]])
    return Pack(lines.data, lines.starts, lines.ends, first), text[filled]
