"""Token counts of whole texts with a sentencepiece BPE model; huge texts by overlapping chunks.

A huge text is encoded in chunks that overlap, with the offsets of their tokens. Neighbouring chunks are spliced at a place in
the overlap where both have a token boundary that is proven to be one in the whole text: BPE only ever joins neighbours into a
piece of the vocabulary, so where no piece holds the two characters around a place side by side, no merge crosses it, and what
stands on its two sides is encoded independently. If an overlap has no such place, it is widened; at last the chunk is.

Scale: map only, no shuffle; memory is bounded by a slice of texts and by one chunk's tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CHUNK, OVERLAP = 32_768, 256
SLICE = 128

_models: dict[str, tuple] = {}


def model(path: str):
    """The processor and the pairs of neighbouring characters that some piece holds; kept by the worker."""
    if path not in _models:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        joined = {
            p[i : i + 2]
            for p in (sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k)))
            for i in range(len(p) - 1)
        }
        _models[path] = sp, joined
    return _models[path]


def stable(joined: set[str], text: str, at: int) -> bool:
    return text[at - 1 : at + 1].replace(" ", "▁") not in joined


def count_tokens(sp, joined: set[str], text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int, int]:
    """Tokens of text, chunks encoded, overlaps widened."""
    if len(text) <= chunk:
        return len(sp.encode(text)), 1, 0
    start = done = total = chunks = widened = 0
    size = chunk
    while True:
        end = min(start + size, len(text))
        part = text[start:end]
        begins = np.fromiter((p.begin for p in sp.encode(part, return_type="proto").pieces), np.int64)
        chunks += 1

        def byte(at: int, start: int = start, part: str = part) -> int:
            return len(part[: at - start].encode())

        low = byte(done)
        if end == len(text):
            return total + int((begins >= low).sum()), chunks, widened
        back, cut = overlap, 0
        while True:
            first = max(done, start, end - back)
            known = set(begins.tolist())
            cut = next((p for p in range(end - 1, first, -1) if stable(joined, text, p) and byte(p) in known), 0)
            if cut or first <= max(done, start):
                break
            back, widened = 2 * back, widened + 1
        if not cut:  # nothing in the whole chunk is proven: the chunk itself grows
            size, widened = 2 * size, widened + 1
            continue
        total += int(((begins >= low) & (begins < byte(cut))).sum())
        start, done, size = max(first, cut - overlap), cut, chunk
        if start == cut:
            start = cut - 1


def counted(batches, path: str, chunk: int, overlap: int):
    """Arrow batches of (key columns..., text) to (key columns..., n_bytes, n_tokens, n_chunks, n_widened)."""
    sp, joined = model(path)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            piece = batch.slice(at, SLICE)
            texts = [t or "" for t in piece.column(piece.num_columns - 1).to_pylist()]
            short = [t if len(t) <= chunk else "" for t in texts]
            n = [(len(x), 1, 0) for x in sp.encode(short, num_threads=1)]
            n = [count_tokens(sp, joined, t, chunk, overlap) if len(t) > chunk else x for t, x in zip(texts, n)]
            cols = [piece.column(k) for k in range(piece.num_columns - 1)] + [
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                *(pa.array([x[k] for x in n], pa.int64()) for k in range(3)),
            ]
            yield pa.RecordBatch.from_arrays(cols, [*piece.schema.names[:-1], "n_bytes", "n_tokens", "n_chunks", "n_widened"])


def token_counts(docs: DataFrame, text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs without its text, plus n_bytes, n_tokens, n_chunks and n_widened. A null text counts as empty: no bytes, no
    tokens. Every row is counted by itself, repeated ones too; an empty table gives no rows. Other columns pass through; those four
    names are replaced."""
    keys = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "n_chunks", "n_widened")]
    rows = docs.select(*(f"`{c}`" for c in keys), f"`{text}`")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]] + ["n_bytes long, n_tokens long, n_chunks long, n_widened long"])
    return rows.mapInArrow(common.on_workers(__name__, "counted", path=path, chunk=chunk, overlap=overlap), schema)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts(docs, "text", public_tokenizers.path(MODEL))
    return out.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {LIMIT} AS over_limit", "n_chunks", "n_widened")
