import json

from graphonic.sources import readers, spellings


def test_specs_and_failures(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"code": "a", "name": "A", "script": "Latin", "iso639_3": "abcd"}))
    (tmp_path / "b.json").write_text(json.dumps({"code": "b", "name": "B", "parent": "gone", "clade": True}))
    (tmp_path / "c.json").write_text("{broken")
    rows = readers.specs(spark, str(tmp_path)).cache()
    assert [r.code for r in readers.listed(rows).where("code is not null").collect()] == ["a"]
    assert [r.code for r in readers.listed(rows, True).where("code is not null").collect()] == ["a", "b"]
    found = {(r.code, r.error) for r in readers.failures(rows).collect()}
    assert ("a", "iso639_3: pattern") in found and ("b", "parent does not load: gone") in found and (None, "unreadable") in found


def test_lexicon(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("the\tðə\n\nbad\nthe\tðiː\nof\tɒv\n")
    assert {(r.word, r.ipa) for r in readers.lexicon(spark, str(tmp_path / "l.tsv")).collect()} == {("the", "ðə"), ("of", "ɒv")}
    problems = {r.line: r.reason for r in readers.lexicon_problems(spellings.LEXICON_LINES.df(spark)).collect()}
    assert problems == {5: "no tab", 6: "more than one tab", 8: "empty word"}


def test_region_profile(spark, tmp_path):
    (tmp_path / "p.csv").write_text("region,ipa_chars,flag,count\nNorth Coast,200,YES,3\nnorth,100,NO,1\n")
    assert {(r.key, r.rate) for r in readers.region_profile(spark, str(tmp_path / "p.csv"), "NORTH").collect()} == {("flag", 1.0), ("count", 0.015)}


def test_json_sink(spark):
    assert json.loads(readers.to_json(spark.createDataFrame([(1, None)], "a int, b string")).first().json) == {"a": 1, "b": None}
