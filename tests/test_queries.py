import pytest
from conftest import same

from piecewright.plans import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_against_sql(spark, sf_dir, duck, name):
    rows = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert len(rows)
    if name in queries.ORACLE_SQL:
        assert same(rows, duck.execute(queries.ORACLE_SQL[name]).df())


def test_added_tokens_against_brute_force(spark, sf_dir):
    """Every token of every text: cut by hand at the added tokens, the parts encoded word by word."""
    from piecewright.functions.unigram import Unigram
    from piecewright.operators import encode as operators

    m, ids_of = queries.ADDED, {t.content: t.id for t in queries.ADDED.matched_added_tokens}
    tokens, encode = sorted(ids_of, key=len, reverse=True), Unigram(m)

    def regular(plain):
        marked = plain.replace(" ", "▁")
        marked = marked if marked.startswith("▁") else "▁" + marked
        return [x for part in marked.split("▁")[1:] for x in encode("▁" + part)] if plain else []

    def plain_tokens(text):
        out, at, begin = [], 0, 0
        while at < len(text):
            hit = next((t for t in tokens if text.startswith(t, at)), None)
            if hit:
                out += [*regular(text[begin:at]), (ids_of[hit], hit)]
                at = begin = at + len(hit)
            else:
                at += 1
        out += regular(text[begin:])
        merged = []
        for i, p in out:
            if merged and i == m.unk_id == merged[-1][0]:
                merged[-1] = (i, merged[-1][1] + p)
            else:
                merged.append((i, p))
        return merged

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for r in operators.encode(docs, m, "text", "e").collect():
        assert list(zip(r["e"]["ids"], r["e"]["pieces"])) == plain_tokens(r["text"])


def test_entry_and_registration():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
