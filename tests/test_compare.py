from pathlode.operators import compare


def test_tree_diff(spark, tmp_path):
    for side, files in (("l", {"a/x.txt": "1", "same.txt": "s", "gone.txt": "g"}), ("r", {"a/x.txt": "2", "same.txt": "s", "b/new.txt": "n"})):
        for name, body in files.items():
            path = tmp_path / side / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(body)
    got = {r.path: r.status for r in compare.tree_diff(spark, str(tmp_path / "l"), str(tmp_path / "r")).collect()}
    assert got == {"a/x.txt": "changed", "same.txt": "same", "gone.txt": "removed", "b/new.txt": "added"}


def test_hints_need_two_different_fields(spark):
    paths = spark.createDataFrame([("$[*].a.code",), ("$[*].b.code",), ("$[*].name",)], "path string")
    found = spark.createDataFrame([("$.a.code", "$.b.code", 1.0), ("$.a.code", "$.name", 0.2)], "field_x string, field_y string, relationship_strength double")
    hints = [compare.Hint("pair", ("code", "name"), "pair", 0.9), compare.Hint("one", ("code", "other"), "pair", 0.9)]
    r = compare.evaluate_hints(hints, paths, found).collect()
    assert [(x.name, x.observed, x.max_strength, len(x.matched_fields)) for x in r] == [("pair", False, 0.2, 3)]


def test_corpus_clusters(spark):
    shapes = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("b", "s2"), ("c", "s2"), ("d", "s3"), ("e", None)], "g string, shape string")
    got = {r.g: (r.cluster, r["size"]) for r in compare.corpus_clusters(shapes, "g").collect()}
    assert got == {"a": ("a", 3), "b": ("a", 3), "c": ("a", 3), "d": ("d", 1)}


def test_cmdclass_override_is_found(spark):
    paths = {1: ["$.metadata", "$.metadata.name", "$.options", "$.options.cmdclass", "$.options.cmdclass.install"], 2: ["$.options", "$.options.cmdclass"], 3: ["$.metadata", "$.options"]}
    nodes = spark.createDataFrame([(d, p) for d, ps in paths.items() for p in ps], "record_id long, path string")
    got = {(r.record_id, r.manifest, r.finding, r.severity, r["count"]) for r in compare.structural_findings(nodes).collect()}
    assert got == {(1, "python", "python_cmdclass_override", "concern", 1)}
