"""Findings of files as they arrive."""

from skein.streaming.watch import findings


def test_new_files_are_linted_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.R").write_text("x <- rnorm(1)\nprint(x)\n")
    rules = ["seeded-randomness", "syntactically-valid"]
    findings(spark, src, out, state, rules).awaitTermination()
    (tmp_path / "src" / "b.R").write_text(") oops\n")
    findings(spark, src, out, state, rules).awaitTermination()
    got = sorted((x.file_id.removeprefix(src + "/"), x.rule) for x in spark.read.parquet(out).collect())
    assert got == [("a.R", "seeded-randomness"), ("b.R", "syntactically-valid")]
