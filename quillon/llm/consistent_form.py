"""Problem 5: visually identical text with different characters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.codepoints import chunks, consistent, decode, encode


def _batches(batches, keys: list[str], fields: list[str], changed_only: bool):
    for batch in batches:
        for a, b in chunks(*batch.columns[len(keys) :]):
            for k, field in enumerate(fields):
                text = batch.column(len(keys) + k).slice(a, b - a)
                cps, off = decode(text)
                new, new_off, changed = consistent(cps, off)
                null = text.is_null().to_numpy(zero_copy_only=False)
                rows = np.flatnonzero(changed) if changed_only else np.arange(len(text))
                if not len(rows):
                    continue
                out = encode(new, new_off, null).cast(pa.string())
                own = [batch.column(i).slice(a, b - a).take(pa.array(rows)) for i in range(len(keys))]
                own += [pa.array([field] * len(rows), pa.string()), out.take(pa.array(rows)), pa.array(changed[rows])]
                yield pa.RecordBatch.from_arrays(own, [*keys, "field", "text", "changed"])


def consistent_form(df: DataFrame, key: str, fields: list[str], changed_only: bool = False) -> DataFrame:
    """(key, field, text, changed): the text columns ``fields`` of ``df`` in the consistent form.

    Full-width characters become plain ones, invisible characters are dropped (a joiner between two
    Devanagari characters stays), odd spaces become plain spaces, letters are composed with the
    combining marks after them, and Cyrillic or Greek letters in words with Latin letters become the
    Latin letters they look like.  The work is done on code-point arrays, a chunk of rows at a time;
    there is no shuffle.

    One row for each row and field; with ``changed_only`` just those whose text is not null and
    differs from its form.  A null text stays null and an empty one empty, neither is ``changed``;
    repeated rows are kept as often as they come; a null key is passed on; other columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        return _batches(batches, [key], fields, changed_only)

    quoted = [f"`{c}`" for c in (key, *fields)]
    return df.select(*quoted).mapInArrow(run, f"`{key}` {kind}, field string, text string, changed boolean")
