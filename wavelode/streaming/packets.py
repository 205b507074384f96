"""Packet reassembly over a live stream of pages, with state by stream.

The state holds what the batch operator's windows see: the open packet's bytes, whether the reader waits for
a boundary, and the last page's index.  ``step`` is pure and shared with tests.  Pages of a stream arrive in
order within a micro-batch's sort by ``page_pos``; a page that goes backward is an error row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CONTINUED = 1
OUT = "path string, serial long, page_index long, granule long, payload binary, error string"
STATE = "partial binary, open boolean, discarding boolean, last_index long"


@dataclass(frozen=True)
class Reassembly:
    partial: bytes = b""
    open: bool = False
    discarding: bool = False
    last_index: int = -1


def step(state: Reassembly, header_type: int, index: int, segments: list[bytes]) -> tuple[Reassembly, list[tuple[bytes | None, str | None]]]:
    """The state after a page, and its packets or errors."""
    if not segments:
        return state, []
    out: list[tuple[bytes | None, str | None]] = []
    partial, opened, discarding = state.partial, state.open, state.discarding
    continued = bool(header_type & CONTINUED)
    if opened and (not continued or index != state.last_index + 1):
        out.append((None, "unexpected end"))
        partial, opened, discarding = b"", False, continued
    elif continued and not opened:
        discarding = True
    elif not continued:
        discarding = False
    for s in segments:
        partial += s
        opened = len(s) == 255
        if not opened:
            if not discarding:
                out.append((partial, None))
            partial, discarding = b"", False
    if discarding:
        partial, opened = b"", False
    return Reassembly(partial, opened, discarding, index), out


def _update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    path, serial = key
    state = Reassembly(bytes(held.get[0]), *held.get[1:]) if held.exists else Reassembly()
    rows = pd.concat(list(frames)).sort_values("page_pos", kind="stable")
    out = []
    for page in rows.itertuples():
        state, made = step(state, page.header_type, page.page_index, [bytes(s) for s in page.segments])
        out += [(path, serial, page.page_index, page.granule, payload, error) for payload, error in made]
    held.update((state.partial, state.open, state.discarding, state.last_index))
    yield pd.DataFrame(out, columns=["path", "serial", "page_index", "granule", "payload", "error"])


def reassemble(pages: DataFrame) -> DataFrame:
    """A streaming frame of pages to one of packets, in append mode."""
    good = pages.where("error IS NULL AND serial IS NOT NULL").select("path", "serial", "page_pos", "header_type", "page_index", "granule", "segments")
    return good.groupBy("path", "serial").applyInPandasWithState(_update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
