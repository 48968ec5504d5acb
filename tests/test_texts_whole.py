"""Text queries whole: nothing beyond an opening is lost, in any language."""

from silt.plans.catalogue import QUERIES


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_words_after_the_opening(spark, tmp_path):
    opening = " ".join(f"word{n}q" for n in range(80))
    tails = [" ".join(f"{c}tail{n}q" for n in range(200)) for c in "ab"]
    rows = [(1, f"{opening} {tails[0]}", "en", "s"), (2, f"{opening} {tails[1]}", "en", "s"), (3, f"{tails[0]} other", "de", "s"), (4, f"{tails[0]} more", None, "s")]
    at = documents(spark, tmp_path, rows)
    sets = {i: set(t.split()) for i, t, _, _ in rows}
    for name, base in (("word_overlap_edges", lambda a, b: min(len(a), len(b))), ("claim_overlap_pairs", lambda a, b: len(a | b))):
        want = {(a, b, len(sets[a] & sets[b])) for b in sets for a in range(1, b) if 5 * len(sets[a] & sets[b]) >= 3 * base(sets[a], sets[b])}
        assert {(r["src"], r["dst"], r["shared"]) for r in QUERIES[name](spark, at).collect()} == want and (1, 2) not in {x[:2] for x in want}
    got = {r["id"]: r["n_content"] for r in QUERIES["claim_content"](spark, at).collect()}
    assert got == {i: len(s) for i, s in sets.items()}


def test_facts_recur_as_whole_texts(spark, tmp_path):
    opening = " ".join(f"word{n}q" for n in range(80))
    rows = [(1, opening + " ".join(f" atail{n}q" for n in range(200)), "en", "s"), (2, opening + " ".join(f" btail{n}q" for n in range(200)), "en", "s")]
    rows += [(n, "Der Dienst braucht immer neue Schlüssel vom Server", lang, "s") for n, lang in ((3, "de"), (4, None))]
    got = QUERIES["consolidated_facts"](spark, documents(spark, tmp_path, rows)).collect()
    assert [(r["n_sessions"], r["text"]) for r in got] == [(2, rows[2][1])]
