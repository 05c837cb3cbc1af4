"""Token counts of hits, by batch encoding inside Arrow functions."""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitmerge.llm.texts import by_bytes

_LOADED: dict[tuple, object] = {}
# A word is never joined with the white space after it, and one space goes with the letter behind
# it, so a text cut before such a space encodes as its two parts do.
_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def encoder(vocabulary: str, pattern: str, special: tuple[tuple[str, int], ...]):
    """Encoder of a rank file, loaded once in each worker."""
    key = (vocabulary, pattern, special)
    if key not in _LOADED:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _LOADED[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))
    return _LOADED[key]


def pieces(text: str, chars: int) -> list[str]:
    """The text cut near every ``chars`` characters, only where the cut leaves its tokens alone."""
    out, start = [], 0
    while len(text) - start > chars:
        at = _SAFE.search(text, start + chars)
        if at is None:
            break
        out.append(text[start:at.start()])
        start = at.start()
    out.append(text[start:])
    return out


def encode(text: str | None, enc, chars: int) -> list[int]:
    if not text:
        return []
    if len(text) <= chars:
        return enc.encode(text, allowed_special="all")
    return [i for p in pieces(text, chars) for i in enc.encode(p, allowed_special="all")]


def count_tokens(hits: DataFrame, vocabulary: str, pattern: str, special: tuple = (), batch_bytes: int = 1 << 20,
                 piece_chars: int = 1 << 16) -> DataFrame:
    """Bytes and tokens of every whole snippet.

    :param hits: ``hit_ord``, ``snippet``; other columns are not read, whatever their names
    :param vocabulary: rank file, at the same path on every executor
    :param pattern: expression that splits a text before the merges
    :param special: (string, id) of the special tokens, which count as one token where a text holds them
    :param batch_bytes: texts are encoded in batches of about this size; batches are balanced by bytes
    :param piece_chars: longer texts are encoded piece by piece, cut where no token can span the cut
    :return: one row per row of ``hits`` with ``hit_ord``, ``n_bytes`` and ``n_tokens``; a null or
        empty snippet has 0 of both, repeated rows and rows without ``hit_ord`` stay as they are
    """
    def lengths(batches):
        enc = encoder(vocabulary, pattern, special)
        for b in batches:
            counts = [len(encode(t, enc, piece_chars)) if t is not None else 0
                      for part in by_bytes(b.column("snippet"), batch_bytes) for t in part]
            yield pa.RecordBatch.from_arrays(
                [b.column("hit_ord"), b.column("n_bytes"), pa.array(counts, pa.int64())], ["hit_ord", "n_bytes", "n_tokens"])

    rows = hits.select(F.col("hit_ord").cast("long").alias("hit_ord"), "snippet",
                       F.coalesce(F.octet_length("snippet"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(lengths, "hit_ord long, n_bytes long, n_tokens long")
