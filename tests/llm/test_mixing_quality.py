from collections import defaultdict

import duckdb
import pytest

from weftgraph.llm import mixing, quality


def against_sql(df, sql, spark_rows):
    table = df.toArrow()
    con = duckdb.connect()
    con.register("documents", table)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = sorted((tuple(r) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in spark_rows), key=repr) == expected


def documents(spark):
    rows = [(i, "word " * (i % 40), f"s{i % 7}" if i % 11 else None) for i in range(300)]
    rows += [(1000, None, "s1"), (1001, "", "s2"), (1002, "big " * 4000, "s3"), (1003, "one", "only"), (1004, "x", "Z"), (1005, "é ", "é")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "7 as size", "'a' as spread")


def test_mix_against_sql(spark):
    df = documents(spark)
    found = mixing.mix(df).collect()
    against_sql(df.select("doc_id", "text", "source"), mixing.ORACLE, found)
    assert all(r.taken <= 3 * r.size and r.target <= 3 * r.source_size for r in found)


def test_sources_come_near_their_targets(spark):
    found = mixing.mix(documents(spark).where("doc_id <> 1002")).collect()
    taken, targets, sizes = defaultdict(int), {}, {}
    for r in found:
        taken[r.source] += r.taken
        targets[r.source], sizes[r.source] = r.target, r.source_size
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-6
    largest = max(r.size for r in found)
    assert all(abs(targets[s] - taken[s]) <= 2 * largest for s in targets)
    assert found and sorted(map(tuple, mixing.mix(documents(spark).where("doc_id <> 1002")).collect()), key=repr) == sorted(map(tuple, found), key=repr)


def test_mixed_documents_repeat_rows(spark):
    df = documents(spark)
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    found = defaultdict(int)
    for r in mixing.mixed_documents(df).collect():
        found[r.doc_id] += 1
    assert dict(found) == {d: n for d, n in copies.items() if n}


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, " ", None)], [(1, "a b", "s"), (1, "a b", "s")]])
def test_mix_of_odd_tables(spark, rows):
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(found) == len(rows)


def test_quality_against_sql(spark):
    line = "The same license line 2024 everywhere in this host"
    rows = [(i, "\n".join([f"w{i} " * 3, line, " ".join(chr(97 + i % 26) * (i + 1) + chr(97 + j % 26) * (j + 1) for j in range(60)), line if i % 9 == 0 else "end"]), "h1") for i in range(60)]
    rows += [(100, None, "h1"), (101, "", None), (102, "a b c a b c a b c " * 30, "h2"), (103, line + "\n" + line.upper().replace("2024", "7"), "h1"), (104, "#$ %&\x0b|<>* x\r\n\n \nx", "h3"), (105, "one two three one two three one", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as n_words", "2 as host")
    found = quality.quality(df.drop("host")).collect()
    against_sql(df.select("doc_id", "text", "source"), quality.ORACLE, found)
    by = {r.doc_id: r for r in found}
    assert by[103].removed_words == 18 and by[105].n_repeat_words == 7 and by[102].base_failed and not by[100].kept and by[1].kept
    assert quality.quality(df.limit(0)).count() == 0
