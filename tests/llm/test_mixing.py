import random
from collections import Counter, defaultdict

from hushscan.llm import mixing

SCHEMA = "doc_id long, text string, source string, key string, size long"


def reshared(sizes, weights, share=1.5, epochs=2):
    """Targets by giving out the excess again and again."""
    want, full = share * sum(sizes), [epochs * s for s in sizes]
    capped, target = set(), {}
    while True:
        rest = want - sum(full[i] for i in capped)
        open_ = [i for i in range(len(sizes)) if i not in capped]
        total = sum(weights[i] for i in open_)
        target = {i: full[i] if i in capped else rest * weights[i] / total for i in range(len(sizes))}
        over = {i for i in open_ if target[i] > full[i]}
        if not over:
            return target
        capped |= over


def fixture(n=300, sources=7, seed=3):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        source = None if draw.random() < 0.1 else f"s{min(draw.randrange(sources), draw.randrange(sources))}"
        text = draw.choice([None, "", " \t"]) if draw.random() < 0.05 else " ".join(["w"] * draw.randint(1, 40))
        rows.append((i if draw.random() < 0.95 else None, text, source, "clash", 5))
    return rows + rows[:20]


def test_targets_are_the_fixed_point_of_resharing(spark):
    rows = fixture()
    got = mixing.curriculum(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source, _, _ in rows:
        sizes[source] += len((text or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = reshared([sizes[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))])
    by_size = {sizes[n]: want[i] for i, n in enumerate(names)}
    taken = Counter()
    for r in got:
        assert abs(r.target - by_size[r.source_size]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(u.words for u in r.uses)
        assert all(0 <= u.position <= 1 for u in r.uses)
        taken[r.source_size] += r.taken
    for size, target in by_size.items():
        assert taken[size] == int(target + 1e-9)


def test_reruns_and_other_partitions_agree(spark):
    df = spark.createDataFrame(fixture(), SCHEMA)
    one = sorted(map(str, mixing.curriculum(df).collect()))
    assert one == sorted(map(str, mixing.curriculum(df.repartition(7)).collect()))


def test_schedules_shape_positions(spark):
    for shape in mixing.Curriculum().shapes:
        pieces = mixing.integrate(shape)
        demands = [i / 50 for i in range(51)]
        df = spark.createDataFrame([(d,) for d in demands], "d double")
        times = [r[0] for r in df.select(mixing.invert(shape, df.d)).collect()]
        assert times == sorted(times) and abs(times[0]) < 1e-12 and abs(times[-1] - 1) < 1e-12
        for d, t in zip(demands, times):
            used = 0.0
            for start, width, h0, h1, _ in pieces:
                x = min(max(t - start, 0), width)
                used += h0 * x + (h1 - h0) * x * x / (2 * width)
            assert abs(used - d) < 1e-9


def test_training_rows_keep_columns_and_cut_the_last_use(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(10)), "abc"[i % 3], "k", i) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.training_rows(df).collect()
    words = defaultdict(int)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert r.asDict().keys() == set(df.columns) and texts[r.doc_id].startswith(r.text)
        words[r.source] += len(r.text.split())
    assert sum(words.values()) == sum(int(t) for t in {r.source_size: r.target for r in mixing.curriculum(df).collect()}.values()) or len(words) == 3
    targets = reshared([100, 100, 100], [3, 1, 2])
    assert [words[s] for s in "abc"] == [int(targets[i]) for i in range(3)]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.curriculum(df).collect() == [] and mixing.training_rows(df).collect() == []
