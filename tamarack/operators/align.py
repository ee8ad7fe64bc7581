"""CTC forced alignment over emissions, one utterance per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..errors import AlignmentError


def forced_alignment(log_probs: np.ndarray, targets: list[int], blank: int = 0) -> list[tuple[int, int, int, float]]:
    """(token, start frame, end frame exclusive, mean posterior) of each target token.

    Viterbi over the blank-expanded labels. A state is kept, reached from the one
    before, or from two before where both are different tokens; of equal scores
    the shorter move wins, and of equal last states the blank.
    """
    scores = np.asarray(log_probs, dtype=np.float64)
    if scores.ndim != 2:
        raise ValueError("emissions must be frames x vocabulary")
    if not targets:
        raise AlignmentError("no target tokens")
    if min(targets) < 0 or max(targets) >= scores.shape[1]:
        raise AlignmentError("a target token is outside the vocabulary")
    if len(scores) < len(targets):
        raise AlignmentError(f"{len(scores)} frames are too few for {len(targets)} tokens")
    labels = np.full(2 * len(targets) + 1, blank)
    labels[1::2] = targets
    skip = np.zeros(len(labels), bool)
    skip[3::2] = labels[3::2] != labels[1:-2:2]
    reach = np.full((3, len(labels)), -np.inf)
    moves = np.zeros((len(scores), len(labels)), np.int8)
    best = np.full(len(labels), -np.inf)
    best[0] = 0.0
    for t, row in enumerate(scores[:, labels]):
        reach[0] = best
        reach[1, 1:] = best[:-1]
        reach[2, 2:] = np.where(skip[2:], best[:-2], -np.inf)
        moves[t] = reach.argmax(axis=0)
        best = np.take_along_axis(reach, moves[t][None, :].astype(np.intp), 0)[0] + row
    state = len(labels) - 1 if best[-1] >= best[-2] else len(labels) - 2
    if not np.isfinite(best[state]):
        raise AlignmentError("no finite path")
    path = np.empty(len(scores), np.intp)
    for t in range(len(scores) - 1, -1, -1):
        path[t] = state
        state -= moves[t, state]
    out = []
    for i, token in enumerate(targets):
        at = np.flatnonzero(path == 2 * i + 1)
        if not len(at):
            raise AlignmentError("a token has no frame")
        out.append((token, int(at[0]), int(at[-1]) + 1, float(np.exp(scores[at, token].mean()))))
    return out


def align_utterances(df: DataFrame, key: str, blank: int = 0) -> DataFrame:
    """Token alignments of ``df`` (key, emissions array<array<float>>, targets array<int>); failures give a ``reason`` row.

    Each row is an utterance of its own, so nothing is shuffled.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, emissions, targets in zip(frame[key], frame["emissions"], frame["targets"], strict=True):
                try:
                    found = forced_alignment(np.stack([np.asarray(e) for e in emissions]), [int(t) for t in targets], blank)
                    rows += [(k, i, *f, None) for i, f in enumerate(found)]
                except (AlignmentError, ValueError, TypeError) as e:
                    rows.append((k, None, None, None, None, None, str(e)))
            names = [key, "place", "token_id", "start_frame", "end_frame", "posterior", "reason"]
            out = pd.DataFrame(rows, columns=names)
            for c in names[1:5]:
                out[c] = out[c].astype("Int64")
            yield out

    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, place long, token_id long, start_frame long, end_frame long, posterior double, reason string"
    return df.select(key, "emissions", "targets").mapInPandas(run, schema)
