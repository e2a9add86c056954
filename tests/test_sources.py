from pyspark.sql import functions as F

from hushscan.functions import paths as P
from hushscan.options import Options, load_options
from hushscan.sources import config, files


def write(root, entries):
    for name, data in entries.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_directory_selection(spark, tmp_path):
    write(tmp_path, {
        "a.py": "x", "b.JS": "x", "c d.tsx": "x", "p+q.md": "x", "pic.png": b"\x89PNG\x00", "Makefile": "x",
        ".env": "x", ".env.local": "x", "node_modules/n.js": "x", "x.egg-info/k.txt": "x",
        "egg-info/k.txt": "x", "hushscan.toml": "x", "notes.rst": "x", "bin": b"\x00\x01", "bad.txt": b"\xff\xfeab",
        "edge.txt": b"a" * 1023 + "é".encode() + b"z", "deep/build/x.py": "x",
    })
    root = str(tmp_path)
    base = {"a.py", "b.JS", "c d.tsx", "p+q.md", "Makefile", ".env", ".env.local", "x.egg-info/k.txt"}
    got = files.read_files(spark, root)
    assert {r.path for r in got.collect()} == base | {"edge.txt"}
    strict = files.read_files(spark, root, strict_sniff=True)
    assert {r.path for r in strict.collect()} == base
    everything = {r.path for r in files.read_files(spark, root, no_ignore=True).collect()}
    assert everything == base | {"edge.txt", "node_modules/n.js", "egg-info/k.txt", "hushscan.toml", "deep/build/x.py"}
    some = files.read_files(spark, root, include=["*.py", "*.md"], exclude=["p*"])
    assert {r.path for r in some.collect()} == {"a.py"}
    one = files.read_files(spark, root + "/notes.rst", explicit=True)
    assert [tuple(r) for r in one.collect()] == [("notes.rst", "x", None)]


def test_rejected_files_are_not_opened(spark, tmp_path):
    write(tmp_path, {"a.py": "x", "pkg/__init__.py": "x", "node_modules/n.js": "y", "z.png": "y"})
    listed = files.list_files(spark, str(tmp_path))
    assert listed.count() == 4
    kept = listed.where(files.accepted_path(F.col("path")))
    assert {r.path for r in kept.collect()} == {"a.py", "pkg/__init__.py"}
    assert files.read_contents(kept, str(tmp_path)).count() == 2


def test_deep_trees_are_listed_in_tasks(spark, tmp_path):
    write(tmp_path, {f"a/b{i}/c/d/e/f{i}.py": "x" for i in range(8)})
    assert {r.path for r in files.list_files(spark, str(tmp_path)).collect()} == {
        f"a/b{i}/c/d/e/f{i}.py" for i in range(8)
    }


def test_decoding(spark, tmp_path):
    write(tmp_path, {"a.txt": b"a\r\nb\rc" + b"x" * 1100 + b"\xffd\xc3", "b.txt": "é\n"})
    got = {r.path: r.text for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "a\nb\nc" + "x" * 1100 + "d", "b.txt": "é\n"}


def test_staged_and_changed(spark):
    rows = [
        ("a.py", bytearray(b"a\r\n"), "A", "1"), ("b.py", bytearray(b"b"), "D", "1"), ("c.py", bytearray(b"\x00"), "M", "1"),
        ("d.py", bytearray(b"\xff"), "M", "1"), ("hushscan.toml", bytearray(b"x"), "A", "1"), ("e.bin", bytearray(b"x"), "C", "1"),
        ("build/f.py", bytearray(b"f"), "C", "2"),
    ]
    snap = spark.createDataFrame(rows, "path string, content binary, change_type string, version string")
    assert {tuple(r) for r in files.staged_texts(snap).collect()} == {("a.py", "a\r\n"), ("build/f.py", "f")}
    old = spark.createDataFrame([("a.py", "1"), ("build/f.py", "1"), ("zz.py", "1")], "path string, version string")
    assert {r.path for r in files.diff_texts(snap, old).collect()} == {"build/f.py", "b.py"}


def test_globs(spark):
    cases = [
        ("*.py", "a/b.py", True), ("src/*", "src/a/b.py", True), ("src/*", "x/src/a", False), ("?.js", "ab.js", False),
        ("[!a].js", "b.js", True), ("[!a].js", "a.js", False), ("[ab]x", "ax", True), ("a[b", "a[b", True),
        ("*.PY", "b.py", False), ("tests/*", "tests/x\n.py", True), ("[]]x", "]x", True), ("a.b", "aXb", False),
    ]
    for glob, path, want in cases:
        df = spark.createDataFrame([(path,)], "path string")
        assert df.select(P.matches_any(F.col("path"), [glob])).first()[0] is want, (glob, path)


def test_artifact_uris(spark):
    pairs = [
        ("app.py", "app.py"), ("./src/app.py", "src/app.py"), ("src\\win\\app.py", "src/win/app.py"),
        ("my file.py", "my%20file.py"), ("dir/a#b.py", "dir/a%23b.py"), ("dir/100%.py", "dir/100%25.py"),
        ("q?x.py", "q%3Fx.py"), ("dép/☃.py", "d%C3%A9p/%E2%98%83.py"), ("~a*b+c", "~a%2Ab%2Bc"),
        ("/tmp/a b", "file:///tmp/a%20b"),
    ]
    df = spark.createDataFrame(pairs, "p string, want string")
    for r in df.select("want", P.artifact_uri(F.col("p")).alias("got")).collect():
        assert r.got == r.want


def test_ignore_lists_and_options(spark, tmp_path):
    lines = spark.createDataFrame([("",), ("# c",), (" docs/ ",), ("*.min.js",)], "value string")
    opts = load_options(tmp_path / "none.toml")
    assert opts == Options()
    (tmp_path / "o.toml").write_text(
        '[scan]\nentropy_threshold = 3\n[scan.ignore]\npaths=["a"]\n[scan.include]\npatterns=["*.py"]\n[output]\nformat="json"\n'
    )
    opts = load_options(tmp_path / "o.toml")
    assert (opts.entropy_threshold, opts.ignore_paths, opts.include_patterns, opts.output_format) == (3.0, ("a",), ("*.py",), "json")
    (tmp_path / "bad.toml").write_text("[[[")
    assert load_options(tmp_path / "bad.toml") == Options()
    got = config.exclude_patterns(["x"], opts, config.ignore_patterns(lines))
    assert got == ("x", "a", "*.min.js", "docs/*")


def test_rules_file(spark, tmp_path):
    path = tmp_path / "r.toml"
    assert config.load_rules(spark, path).rules == ()
    path.write_text(
        '[[rules]]\nname="Internal"\npattern="INT-[0-9]{6}"\n[[rules]]\nname="Broken"\npattern="["\n'
        '[[rules]]\npattern="x"\n[[rules]]\nname="n"\n'
    )
    loaded = config.load_rules(spark, path)
    assert [n for n, _ in loaded.rules] == ["Internal"]
    assert [(i, n) for i, n, _ in loaded.errors] == [(1, "Broken"), (2, None), (3, "n")]
    path.write_text("rules = 3")
    assert len(config.load_rules(spark, path).errors) == 1
    path.write_text("[[[")
    assert len(config.load_rules(spark, path).errors) == 1
    assert loaded.errors_frame(spark).count() == 3


def test_an_unreadable_file_is_a_row(spark, tmp_path):
    (tmp_path / "a.py").write_text("x")
    listed = spark.createDataFrame(
        [("a.py", str(tmp_path / "a.py"), 1), ("gone.py", str(tmp_path / "gone.py"), 1)], "path string, location string, length long"
    )
    got = {r.path: r for r in files.read_contents(listed, str(tmp_path)).collect()}
    assert bytes(got["a.py"].content) == b"x" and got["a.py"].error is None
    assert got["gone.py"].content is None and got["gone.py"].error


def test_long_ignore_lists_are_folded(spark):
    from hushscan.functions.paths import matches_any
    from pyspark.sql import functions as F

    globs = [f"lib{i}/*.py" for i in range(3000)] + [f"name{i}" for i in range(3000)]
    df = spark.createDataFrame([("lib2999/x.py",), ("a/name17",), ("lib3000/x.py",)], "p string")
    assert [r[0] for r in df.select(matches_any(F.col("p"), globs)).collect()] == [True, True, False]


def test_a_large_flat_folder(spark, tmp_path):
    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(25_000):
        (flat / f"f{i}.txt").touch()
    (tmp_path / "loop").symlink_to(tmp_path)
    listed = files.list_files(spark, str(tmp_path))
    assert "LocalRelation" not in listed._jdf.queryExecution().optimizedPlan().toString()
    assert listed.count() == listed.select("path").distinct().count() == 25_000
    assert files.list_files(spark, str(tmp_path / "missing")).count() == 0


def test_large_binaries_are_not_read_whole(spark, tmp_path):
    write(tmp_path, {"a.txt": "x" * 5000, "b.txt": "y"})
    for i in range(4):
        with open(tmp_path / f"big{i}.txt", "wb") as out:
            out.truncate(40 << 30)  # sparse, all NUL
    assert sorted((r.path, len(r.text)) for r in files.read_files(spark, str(tmp_path)).collect()) == [("a.txt", 5000), ("b.txt", 1)]


def test_the_head_of_a_file_is_judged_as_its_content(spark):
    import random

    from hushscan.functions import content

    draw = random.Random(4)
    pieces = [b"a", "é".encode(), "\u2603".encode(), "\U0001f600".encode(), b"\xff", b"\x00", b"\xed\xa0\x80", b"\xc3"]
    given = []
    for _ in range(400):
        data = b"a" * draw.choice([0, 5, 1018, 1020, 1021, 1022, 1023, 1024])
        data += b"".join(draw.choices(pieces, [8, 4, 4, 4, 1, 1, 1, 1], k=draw.randint(0, 9)))
        given.append((bytearray(data),))
    df = spark.createDataFrame(given, "content binary")
    for strict in (False, True):
        told = df.select("content", content.looks_binary(F.col("content"), strict).alias("b")).collect()
        assert [files._binary_head(bytes(r.content)[:1027], strict) for r in told] == [r.b for r in told]


def test_files_are_dealt_by_bytes(spark):
    rows = [(f"f{i:04d}", f"f{i:04d}", 64 << 20 if i < 40 else 10) for i in range(400)]
    dealt = files._dealt(spark.createDataFrame(rows, "path string, location string, length long"))
    shares = [r["count"] for r in dealt.join(spark.createDataFrame(rows, "path string, l2 string, length long"), "path").where("length > 10").groupBy("share").count().collect()]
    assert dealt.count() == 400 and len(shares) > 10 and max(shares) <= 5
