"""Stages in Python hold a bounded part of a batch."""

import base64
from types import SimpleNamespace

import pyarrow as pa

from wirelens.operators import extract


def test_encoding_chains_hold_a_few_texts(spark):
    """One batch of 30 MB, as a session with a bound of its own may hand out: what is made of it comes in small batches, whole."""
    values = [base64.b64encode(f"text {k} ".encode() * 2000).decode() for k in range(1000)]
    rows = spark.createDataFrame([], "k int, value string")
    made = SimpleNamespace(schema=rows.schema, sparkSession=spark, mapInArrow=lambda run, schema: run)
    run = extract.encoding_chains(made)
    whole = pa.RecordBatch.from_arrays([pa.array([*range(1000), 1000, 1001], pa.int32()), pa.array([*values, None, "AAAA" * 2_000_000])], ["k", "value"])
    k, longest = [], 0
    for batch in run(iter([whole])):
        k += batch.column("k").to_pylist()
        longest = max(longest, batch.nbytes if batch.num_rows > 1 else 0)
        for at, (steps, final) in zip(batch.column("k").to_pylist(), zip(batch.column("steps").to_pylist(), batch.column("final").to_pylist())):
            assert at >= 1000 or (steps, final) == (["Base64"], f"text {at} " * 2000)
    assert k == list(range(1002)) and longest < 10 << 20
