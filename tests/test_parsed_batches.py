"""Parsers give rows back after few files."""

import pandas as pd

from codeloom.operators import parsers


def test_a_worker_holds_the_rows_of_few_files():
    """A batch of Spark has up to 10,000 files; the rows of all of them were held at once."""
    n = 2 * parsers.TOGETHER + 1
    batch = pd.DataFrame([("p", f"f{k}.js", "JavaScript", f"export function g{k}(a) {{\n}}\n") for k in range(n)], columns=["project_id", "file_path", "language", "content"])
    got = list(parsers.parsed_batches(iter([batch, batch.iloc[:0]])))
    assert [x.file_path.nunique() for x in got] == [parsers.TOGETHER, parsers.TOGETHER, 1]
    assert {(r.file_path, r.name) for x in got for r in x[x.table == "symbol"].itertuples(index=False)} >= {(f"f{k}.js", f"g{k}") for k in range(n)}
