"""Tables whose columns have the names that operators use inside, in every operator and stage that keeps columns."""

import pytest

from gleanguard.llm.exact_dedup import drop_duplicates, duplicate_groups
from gleanguard.llm.ngram_join import drop_near_duplicates, near_duplicates
from gleanguard.llm.suffix_dedup import drop_repeated_passages, repeated_passages
from gleanguard.llm.toxicity import FactorizationMachine, drop_toxic, score

NAMES = (
    "alarm _alarm bitmap _block _block0 _bitmap0 _keep_id _keep_sha256 _gone _GONE_ID _gone_mark _gone_sha256 _text_sha256 _at _bits _mark mark stay rows row "
    "set_id bands block file chunk place _file _row slice kept _metadata doc_tokens start score held_out shard slot bucket"
).split()


@pytest.fixture(scope="module")
def table(spark):
    long = "word " * 30
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, long + "x" * 300), (4, long + "y" * 40 + "x" * 300), (None, None), (5, ""), (None, "z"), (None, "z")]
    return spark.createDataFrame([(i, *(f"{n}{k}" for n in NAMES), t) for k, (i, t) in enumerate(rows)], "doc_id long, " + ", ".join(f"`{n}` string" for n in NAMES) + ", text string")


@pytest.mark.parametrize("drop, left", [(drop_duplicates, 5), (drop_near_duplicates, 5), (drop_repeated_passages, 8), (lambda df: drop_toxic(df, FactorizationMachine()), 8)])
def test_columns_come_back_as_they_were(table, drop, left):
    out = drop(table)
    assert out.schema.names == table.schema.names
    got = [r.asDict() for r in out.collect()]
    given = {tuple(r[n] for n in NAMES) for r in table.collect()}
    assert len(got) == left and {tuple(r[n] for n in NAMES) for r in got} <= given
    assert drop(table.limit(0)).count() == 0


@pytest.mark.parametrize("operator", [duplicate_groups, near_duplicates, repeated_passages, lambda df: score(df, FactorizationMachine())])
def test_other_columns_are_not_read(table, operator):
    assert operator(table).count() == table.count()
