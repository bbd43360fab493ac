"""Token counts at every prefix, kept so that budgets need no second encoding.

``PrefixCounts`` (wordbpe) tabulates counts by dynamic programming; this module
applies it to tables. The tokenizer file is opened where the tasks run, from a
path that must exist on every machine.

Defined results
    * null text: as an empty one (0 bytes, 0 tokens);
    * special strings inside texts count as the library counts them by default,
      no special token is added, nothing is cut or padded;
    * repeated rows, ties and null ids come back row for row; an empty table
      gives no rows; columns other than the two named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domsift.llm.wordbpe import PrefixCounts

_COUNTERS: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _counter(path: str) -> PrefixCounts:
    if path not in _COUNTERS:  # a Python worker serves many tasks
        _COUNTERS[path] = PrefixCounts(path)
    return _COUNTERS[path]


def count_tokens(
    df: DataFrame,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    with_store: bool = False,
) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit and kept_chars.

    ``kept_chars``: code points of the longest prefix of no more than ``limit``
    tokens. ``with_store`` adds ``store``, the counts at the end of each word of
    the tokenizer's cut, from which ``PrefixCounts.at`` and
    ``PrefixCounts.longest`` answer any other prefix or budget.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            size, count, kept, stores = [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                store = counter.store(text)
                size.append(len(text.encode()))
                count.append(int(store[-1]) if len(store) else 0)
                kept.append(counter.longest(text, store, limit))
                if with_store:
                    stores.append(store)
            columns = [
                batch.column(0),
                pa.array(size, pa.int64()),
                pa.array(count, pa.int64()),
                pa.array([n > limit for n in count], pa.bool_()),
                pa.array(kept, pa.int64()),
            ]
            names = [id_col, "n_bytes", "n_tokens", "over_limit", "kept_chars"]
            if with_store:
                columns.append(pa.array(stores, pa.list_(pa.int64())))
                names.append("store")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, kept_chars long"
    if with_store:
        schema += ", store array<long>"
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
