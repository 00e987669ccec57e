import hashlib
import math
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.models import forest, growing, likelihood, linear, logit, pruning, store, trees
from surveyloom.models.design import Term, answer_patterns, design_matrix
from surveyloom.plans import heart, heart_queries, modelling

G = Term("g", ("a", "b", "c"))
H = Term("h", ("u", "v"))
X = Term("x")
DOUBLE_H = Term("h2", ("u", "v"))


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(1500):
        g, h, x = "abc"[rng.integers(3)], "uv"[rng.integers(2)], float(rng.integers(0, 12))
        eta = -1 + {"a": 0, "b": 0.8, "c": -0.5}[g] + (0.6 if h == "v" else 0) + 0.12 * x
        rows.append((i, g, h, h, x, "Yes" if rng.random() < 1 / (1 + math.exp(-eta)) else "No"))
    rows += [(9001, None, "u", "u", 1.0, "Yes"), (9002, "a", "u", "u", None, "No"), (9003, "a", "v", "v", 2.0, None),
             (9004, "zz", "u", "u", 1.0, "No")]
    return spark.createDataFrame(rows, "id bigint, g string, h string, h2 string, x double, hd string").cache()


def numpy_design(people, terms):
    design = design_matrix(people, terms, "hd", "Yes").toPandas().to_numpy()
    return design[:, 0], np.column_stack([np.ones(len(design)), design[:, 1:]])


def newton(y, x, offset=0.0):
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ beta + offset)))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    p = 1 / (1 + np.exp(-(x @ beta + offset)))
    covariance = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)
    return beta, covariance, -2 * np.sum(y * np.log(p) + (1 - y) * np.log(1 - p))


def test_incomplete_rows_leave_the_design(people):
    design = design_matrix(people, [G, H, X], "hd", "Yes", keep=["id"])
    assert design.count() == 1500
    assert design.columns == ["id", "y", "gb", "gc", "hv", "x"]


def test_logit_equals_newton(people):
    fit = logit.fit_logit(answer_patterns(people, [G, H, X], "hd", "Yes"), [G, H, X])
    beta, covariance, deviance = newton(*numpy_design(people, [G, H, X]))
    assert np.allclose(list(fit.estimates.values()), beta, atol=1e-6)
    assert np.allclose(list(fit.errors.values()), np.sqrt(np.diag(covariance)), atol=1e-6)
    assert math.isclose(fit.deviance, deviance, rel_tol=1e-9)
    assert math.isclose(fit.aic, deviance + 2 * 5, rel_tol=1e-9)
    y, _ = numpy_design(people, [G, H, X])
    share = y.mean()
    assert math.isclose(fit.null_deviance, -2 * np.sum(y * np.log(share) + (1 - y) * np.log(1 - share)))
    scored = people.select("id", "g", fit.probability().alias("p")).collect()
    assert {r.id for r in scored if r.p is None} == {9001, 9002, 9004}


def test_determined_columns_are_reported_and_left_out(spark, people):
    terms = [G, H, X, DOUBLE_H]
    fit = logit.fit_logit(answer_patterns(people, terms, "hd", "Yes"), terms)
    assert fit.aliased == ("h2v",)
    table = {r.coefficient: r.estimate for r in logit.coefficient_table(spark, fit).collect()}
    assert table["h2v"] is None and len(table) == 6
    beta, _, _ = newton(*numpy_design(people, [G, H, X]))
    assert np.allclose(list(fit.estimates.values()), beta, atol=1e-6)


def test_alias_check_bears_large_offsets(spark):
    df = spark.range(200).select((F.col("id") + 1e6).alias("x"), (F.col("id") * 2 + 3.0).alias("twice"),
                                 F.lit(4.0).alias("flat"), F.rand(1).alias("noise"))
    product = linear.cross_products(df, [F.col(c) for c in df.columns], F.lit(1.0))
    assert linear.independent_columns(product) == [0, 3]


def test_profile_limits_reach_the_critical_deviance(people, spark):
    terms = [H, X]
    patterns = answer_patterns(people, terms, "hd", "Yes")
    fit = logit.fit_logit(patterns, terms)
    y, x = numpy_design(people, terms)
    limits = {r.coefficient: r for r in logit.odds_ratio_limits(spark, fit, patterns, method="profile").collect()}
    for place, name in enumerate(fit.estimates):
        for limit in (limits[name].lower, limits[name].upper):
            rest = [j for j in range(x.shape[1]) if j != place]
            held = newton(y, x[:, rest], math.log(limit) * x[:, place])[2]
            assert math.isclose(held - fit.deviance, 3.841459, abs_tol=2e-3)


def test_gvif_equals_numpy(people):
    terms = [G, H, X]
    patterns = answer_patterns(people, terms, "hd", "Yes")
    got = {r.term: r for r in logit.gvif(patterns, logit.fit_logit(patterns, terms)).collect()}
    covariance = newton(*numpy_design(people, terms))[1][1:, 1:]
    spread = np.sqrt(np.diag(covariance))
    r = covariance / np.outer(spread, spread)
    expected = np.linalg.det(r[:2, :2]) * np.linalg.det(r[2:, 2:]) / np.linalg.det(r)
    assert math.isclose(got["g"].gvif, expected, rel_tol=1e-5)
    assert got["g"].df == 2 and math.isclose(got["g"].gvif_adjusted, expected ** 0.25, rel_tol=1e-5)


def test_backward_elimination_lowers_aic_and_drops_the_idle_term(spark, people):
    noisy = people.withColumn("z", F.pmod(F.xxhash64("id"), F.lit(5)).cast("double"))
    terms = [G, X, DOUBLE_H, H, Term("z")]
    final, steps = logit.eliminate_backward(answer_patterns(noisy, terms, "hd", "Yes"), terms)
    assert steps[1].dropped == "h" and steps[1].deviance == steps[0].deviance
    aics = [s.aic for s in steps]
    assert aics == sorted(aics, reverse=True)
    assert {t.name for t in final.terms} >= {"g", "x", "h2"}
    table = logit.step_table(spark, steps).orderBy("step").collect()
    assert [r.dropped for r in table] == [s.dropped for s in steps]


# ---- trees

@pytest.fixture(scope="module")
def grown(people):
    patterns = answer_patterns(people, [G, H, X], "hd", "Yes", keep=[pruning.fold_of("id", 200, 4)])
    return pruning.cp_table(patterns, [G, H, X], folds=4, max_depth=8, min_split=2, min_bucket=1)


def test_tree_counts_rows_and_not_patterns(grown):
    tree, _ = grown
    assert tree.nodes[0].n == 1500
    for node in tree.nodes.values():
        if not node.is_leaf:
            left, right = tree.nodes[node.left], tree.nodes[node.right]
            assert np.allclose(np.add(left.counts, right.counts), node.counts)


def test_pruning_minimises_cost_complexity(grown):
    """Against the best of all prunings, found by recursion."""
    tree, rows = grown
    strengths = pruning.link_strengths(tree)

    def best(node_id, alpha):
        node = tree.nodes[node_id]
        if node.is_leaf:
            return node.loss + alpha
        return min(node.loss + alpha, best(node.left, alpha) + best(node.right, alpha))

    root = tree.nodes[0].loss
    for cp in [r[0] for r in rows] + [0.0001, 0.002, 0.01, 0.05]:
        pruned = pruning.prune(tree, cp, strengths)
        alpha = cp * root
        assert math.isclose(pruned.loss + alpha * (pruned.splits + 1), best(0, alpha), abs_tol=1e-6)


def test_complexity_table_is_ordered(grown):
    _, rows = grown
    cps, splits, rel, xerror, xstd = zip(*rows)
    assert list(cps) == sorted(cps, reverse=True) and cps[-1] == 0.0
    assert list(splits) == sorted(splits) and splits[0] == 0
    assert list(rel) == sorted(rel, reverse=True) and rel[0] == 1.0
    assert xerror[0] == 1.0 and all(s > 0 for s in xstd)


def test_pruned_tree_predicts_as_its_node_table_says(spark, people, grown):
    tree, rows = grown
    pruned = pruning.prune(tree, rows[len(rows) // 2][0])
    predicted = pruning.predict_class(people.where("id < 9000"), pruned).cache()
    wrong = predicted.where("hd <> predicted").count()
    assert wrong == pruned.loss
    listing = pruning.node_table(spark, pruned)
    assert listing.where("is_leaf").agg(F.sum("n"), F.sum("loss")).first() == (1500.0, float(wrong))
    assert math.isclose(pruning.tree_importance(spark, pruned).agg(F.sum("importance")).first()[0], 1.0)


def test_nodes_below_the_split_size_are_leaves(people):
    patterns = answer_patterns(people, [G, H, X], "hd", "Yes")
    tree = trees.grow_tree(patterns, [G, H, X], max_depth=8, min_split=200, min_bucket=50)
    assert len(tree.nodes) > 3
    for node in tree.nodes.values():
        assert node.n >= 50 and (node.is_leaf or node.n >= 200)


@pytest.mark.parametrize("cps, xerrors, chosen, cp", [
    ((0.3, 0.1, 0.05, 0.02, 0.01, 0.0), (0.5, 0.9, 0.9, 0.9, 0.9, 0.9), (1, 1), 0.3),
    ((0.3, 0.1, 0.05, 0.02, 0.01, 0.0), (1.0, 0.9, 0.72, 0.70, 0.71, 0.8), (4, 3), math.sqrt(0.1 * 0.05)),
])
def test_cp_selection(spark, cps, xerrors, chosen, cp):
    table = pruning.cp_frame(spark, [(c, i, 1.0, x, 0.03) for i, (c, x) in enumerate(zip(cps, xerrors))])
    row = pruning.select_cp(table).first()
    assert (row.min_index, row.optimal_index) == chosen
    assert math.isclose(row.cp, cp) and math.isclose(row.cap, min(xerrors) + 0.03)


# ---- forests

def drawn(row_id, seed, tree):
    return int(hashlib.md5(f"{row_id}:{seed}:{tree}".encode()).hexdigest()[:8], 16) / 2 ** 32


def test_bootstraps_are_poisson_and_can_be_replayed(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "row_id")
    got = rows.select("row_id", forest.draws(4, 200).alias("u"),
                      F.transform(forest.draws(4, 200), forest.times_drawn).alias("w")).collect()
    w = np.array([r.w[3] for r in got])
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.06 and abs((w == 0).mean() - math.exp(-1)) < 0.01
    assert all(r.u[t] == drawn(r.row_id, 200, t) for r in got[:200] for t in range(4))


def same_tree(a, b):
    return (np.array_equal(a.term, b.term) and np.array_equal(a.left, b.left) and np.array_equal(a.counts, b.counts)
            and np.array_equal(a.threshold, b.threshold, equal_nan=True) and np.array_equal(a.goes_left, b.goes_left))


@pytest.mark.parametrize(("local_rows", "dense"), [(300, 1 << 24), (40, 16)])
def test_counted_levels_and_grown_out_nodes_make_the_same_trees(people, monkeypatch, local_rows, dense):
    rows = forest.labelled_rows(people, [G, H, X], "hd", "Yes", "id")
    whole = forest.fit_forest(rows, [G, H, X], trees=3)
    patterns = answer_patterns(people, [G, H, X], "hd", "Yes", keep=[pruning.fold_of("id", 200, 3)])
    tree, table = pruning.cp_table(patterns, [G, H, X], folds=3, min_split=10, min_bucket=4)
    monkeypatch.setattr(growing, "LOCAL_ROWS", local_rows)
    monkeypatch.setattr(growing, "DENSE_CELLS", dense)
    assert all(same_tree(a, b) for a, b in zip(whole.trees, forest.fit_forest(rows, [G, H, X], trees=3).trees, strict=True))
    again, same_table = pruning.cp_table(patterns, [G, H, X], folds=3, min_split=10, min_bucket=4)
    assert same_tree(tree.splits, again.splits) and table == same_table and len(table) > 3


def plain_split(values, y, w, factor, min_bucket=1):
    """Impurity saved by the best of all splits: every cut of a number, every grouping of levels."""
    def impurity(mask):
        n, hits = w[mask].sum(), (w * y)[mask].sum()
        return hits * (n - hits) / n if n else 0.0
    distinct = sorted(set(values))
    groups = ([g for k in range(1, len(distinct)) for g in combinations(distinct, k)] if factor
              else [distinct[:k] for k in range(1, len(distinct))])
    best = 0.0
    for group in groups:
        left = np.isin(values, group)
        if min(w[left].sum(), w[~left].sum()) >= min_bucket:
            best = max(best, impurity(left | True) - impurity(left) - impurity(~left))
    return best


def test_every_split_is_the_best_of_all(people):
    rng = np.random.default_rng(4)
    values = np.column_stack([rng.integers(0, 5, 300), rng.integers(0, 9, 300) / 4, rng.integers(0, 3, 300)]).astype(float)
    y = (rng.random(300) < 0.2 + 0.12 * values[:, 0] % 0.5).astype(float)
    w, factors = rng.integers(1, 4, 300).astype(float), [True, False, True]
    limits = growing.Limits(max_depth=4, min_bucket=5, min_split=12)
    tree = growing.assembled(growing.grow_out(values, y, w, factors, limits, 0, 1), 5)
    reached = {0: np.arange(300)}
    for i in range(len(tree.term)):
        rows = reached[i]
        assert tree.counts[i].tolist() == [(w * (1 - y))[rows].sum(), (w * y)[rows].sum()]
        best = max(plain_split(values[rows, j], y[rows], w[rows], factors[j], 5) for j in range(3))
        if tree.term[i] < 0:
            continue
        j = tree.term[i]
        left = (tree.goes_left[i, values[rows, j].astype(int)] if factors[j] else values[rows, j] <= tree.threshold[i])
        reached[tree.left[i]], reached[tree.right[i]] = rows[left], rows[~left]
        saved = growing.np.subtract(*[sum(c[0] * c[1] / c.sum() for c in part) for part in (
            [tree.counts[i]], [tree.counts[tree.left[i]], tree.counts[tree.right[i]]])])
        assert math.isclose(saved, best, rel_tol=1e-9)
        assert min(tree.counts[k].sum() for k in (tree.left[i], tree.right[i])) >= 5
    ends = tree.leaves(values)
    assert all(i in reached and set(np.flatnonzero(ends == i)) == set(reached[i]) for i in np.flatnonzero(tree.term < 0))
    assert (tree.term >= 0).sum() > 4


@pytest.mark.parametrize("root", [10, 3986, 10 ** 7])
def test_prune_at_a_cp_of_the_table_gives_its_row(root):
    """Whatever the size of the losses; the smallest differ by one row."""
    rng = np.random.default_rng(root % 97)
    for _ in range(20):
        counts, term, left, right = [(2 * root + 1, root)], [0], [0], [0]
        for i in range(60):  # split leaves at random
            if i >= len(counts) or min(counts[i]) < 1:
                continue
            no, yes = (int(rng.integers(0, c + 1)) for c in counts[i])
            if 0 < no + yes < sum(counts[i]):
                term[i], left[i], right[i] = 0, len(counts), len(counts) + 1
                counts += [(no, yes), (counts[i][0] - no, counts[i][1] - yes)]
                term += [-1, -1]
                left += [-1, -1]
                right += [-1, -1]
        n = len(term)
        splits = growing.Splits(np.array([t if x > 0 else -1 for t, x in zip(term, left)]), np.full(n, 0.5), np.zeros((n, 1), bool),
                                np.array([x if x > 0 else -1 for x in left]), np.array([x if x > 0 else -1 for x in right]), np.array(counts, float))
        tree = trees.Tree((X,), splits)
        strengths = pruning.link_strengths(tree)
        rows = pruning.cp_rows(tree, strengths)
        assert rows[0][1:] == (0, 1.0) or rows[0][0] == 0.0
        for cp, nsplit, rel_error in rows:
            pruned = pruning.prune(tree, cp, strengths)
            assert pruned.splits == nsplit and math.isclose(pruned.loss / root, rel_error)
        assert len({cp for cp, _, _ in rows}) == len(rows)


def test_cp_table_prunes_in_tasks(people):
    """The driver keeps arrays only, and a fold without rows has no errors."""
    patterns = answer_patterns(people, [G, H, X], "hd", "Yes", keep=[pruning.fold_of("id", 200, 3)])
    tree, rows = pruning.cp_table(patterns, [G, H, X], folds=3)
    assert "nodes" not in vars(tree) and len(rows) > 2
    penalties = [[math.inf, 1.0], [0.5], [math.inf]]
    by_fold = pruning.held_out_errors(patterns.where("fold <> 1"), [tree] * 3, penalties)
    wrong = patterns.where("fold = 2").agg(F.sum("positive"), F.sum("weight")).first()
    assert [len(each) for each in by_fold] == [2, 1, 1] and by_fold[1] == [0.0]
    assert by_fold[2] == [wrong[1] - wrong[0] if tree.splits.labels[0] else wrong[0]]


def answered(spark, count, terms, response, id_column):
    """Training rows of few answer patterns; every fourth row, and more with a high first number, is positive."""
    place = F.pmod(F.floor(F.col("id") / 7), F.lit(4)).cast("int")
    answers = [(F.element_at(F.array(*map(F.lit, t.levels)), F.least(place, F.lit(len(t.levels) - 1)) + 1) if t.is_factor and i < 2
                else F.lit(t.levels[0]) if t.is_factor else place.cast("double")).alias(t.name) for i, t in enumerate(terms)]
    hit = (F.col("id") % 4 == 0) | ((place == 3) & (F.col("id") % 3 == 0))
    return spark.range(count).select(F.col("id").alias(id_column), F.lit(True).alias("train"), *answers,
                                     F.when(hit, "Yes").otherwise("No").alias(response))


def test_trees_of_the_queries_are_fitted_on_every_row(spark, monkeypatch):
    count = 1_000_400
    rows = answered(spark, count, modelling.PREDICTORS, "hd", "resp_id")
    monkeypatch.setattr(modelling, "_part", lambda spark, folder, train: rows)
    folds = {r.fold: r.n for r in modelling._folded(spark, "every row").groupBy("fold").agg(F.sum("weight").alias("n")).collect()}
    assert len(folds) == 10 and sum(folds.values()) == count
    rows = answered(spark, count, heart.ALL_TERMS, "HEART_DISEASE", "row_id")
    monkeypatch.setattr(heart_queries, "heart_parts", lambda spark, folder: rows)
    tree, _ = heart_queries._tree(spark, "every row")
    positive = rows.where("HEART_DISEASE = 'Yes'").count()
    assert tree.splits.counts[0].tolist() == [count - positive, positive] and len(tree.splits.term) > 1


def test_link_strengths_of_a_deep_tree():
    """Splits in a chain, each saving one row more than the one below: every one goes by itself, in little time."""
    depth, other = 6_000, 10 ** 9
    n = 2 * depth + 1
    place = np.arange(n)
    inner = (place % 2 == 0) & (place < n - 1)
    # Node 2k splits off a pure leaf of depth - k positives.
    yes = np.where(place % 2 == 0, (depth - place // 2) * (depth - place // 2 + 1) // 2, depth - place // 2)
    no = np.where(place % 2 == 0, other, 0)
    tree = trees.Tree((X,), growing.Splits(np.where(inner, 0, -1), np.full(n, 0.5), np.zeros((n, 1), bool),
                                           np.where(inner, place + 1, -1), np.where(inner, place + 2, -1),
                                           np.stack([no, yes], axis=1).astype(float)))
    start = time.process_time()
    assert pruning.link_strengths(tree) == {2 * k: depth - k for k in range(depth)}
    assert time.process_time() - start < 5


def test_forest_does_not_depend_on_partitions(people):
    rows = forest.labelled_rows(people, [G, H, X], "hd", "Yes", "id")
    one, other = (forest.fit_forest(rows.repartition(n), [G, H, X], trees=4, max_depth=8) for n in (1, 7))
    assert all(same_tree(a, b) for a, b in zip(one.trees, other.trees, strict=True))


def test_out_of_bag_curve(people):
    terms = [G, H, X]
    rows = forest.labelled_rows(people, terms, "hd", "Yes", "id")
    grown = forest.fit_forest(rows, terms, trees=6, max_depth=5)
    given = rows.select("row_id", "y", *[t.position().alias(t.name) for t in terms]).collect()
    votes = np.array([t.classes(np.array([[r[n.name] for n in terms] for r in given])) for t in grown.trees])
    counted = {}
    for i, row in enumerate(given):
        for k in range(1, 7):
            cast = [votes[t, i] for t in range(k) if drawn(row.row_id, grown.seed, t) < math.exp(-1)]
            if cast:
                key = (k, "Yes" if row.y else "No", "Yes" if 2 * sum(cast) > len(cast) else "No")
                counted[key] = counted.get(key, 0) + 1
    curve = forest.oob_curve(rows, grown)
    assert {(r.trees, r.actual, r.predicted): r.n for r in curve.collect() if r.n} == counted
    errors = {r.trees: r for r in forest.curve_errors(curve).collect()}
    wrong = sum(n for (k, a, p), n in counted.items() if k == 6 and a != p)
    total = sum(n for (k, _, _), n in counted.items() if k == 6)
    assert errors[6].n_rows == total and math.isclose(errors[6].oob, wrong / total)
    majority = {r.row_id: r.predicted for r in forest.predict_forest(rows, grown).collect()}
    assert majority == {r.row_id: "Yes" if votes[:, i].sum() > 3 else "No" for i, r in enumerate(given)}


def test_no_node_of_a_forest_comes_to_the_driver(people, monkeypatch):
    """And where rows and trees are cut into slices and groups shows in nothing."""
    terms = [G, H, X]
    rows = forest.labelled_rows(people, terms, "hd", "Yes", "id")
    grown = forest.fit_forest(rows, terms, trees=5, max_depth=6)

    def results():
        return [sorted(map(tuple, found.collect())) for found in (
            forest.oob_curve(rows, grown), forest.predict_forest(rows, grown), forest._drops(rows, grown, 200, 400))]

    whole = results()
    monkeypatch.setattr(forest, "SLICE_ROWS", 400)
    monkeypatch.setattr(forest, "GROUP_NODES", 50)
    listed = sorted(map(str, store.node_rows(people.sparkSession, grown.trees, terms).collect()))
    assert "trees" not in forest.Forest.__dataclass_fields__ and len(whole[0]) == 20
    assert listed == sorted(map(str, store.forest_node_rows(grown).collect()))
    assert results() == whole


def test_every_value_is_swapped_exactly_once(people):
    rows = forest.labelled_rows(people, [G, H, X], "hd", "Yes", "id")
    for block_rows in (100_000, 100):
        swapped = forest.shuffled_neighbours(rows, ["g", "x"], 200, block_rows).select("row_id", "g", "x", "swap.*")
        got = swapped.toPandas()
        columns = got.columns.tolist()
        assert columns == ["row_id", "g", "x", "g", "x"]
        own, new = got.iloc[:, 1:3], got.iloc[:, 3:5]
        assert sorted(map(tuple, own.to_numpy())) == sorted(map(tuple, new.to_numpy()))
        assert (own.to_numpy() != new.to_numpy()).any(axis=1).mean() > 0.8


def test_stretches_of_the_random_order_show_in_nothing(people):
    rows = forest.labelled_rows(people, [G, H, X], "hd", "Yes", "id")
    found = [{r.row_id: tuple(r.swap) for r in forest.shuffled_neighbours(rows, ["g", "x"], 200, block_rows).collect()}
             for block_rows in (100_000, 100, 3)]
    assert found[0] == found[1] == found[2]
    order = sorted(found[0], key=lambda i: hashlib.md5(f"{i}:200:order".encode()).hexdigest())
    own = {r.row_id: (r.g, r.x) for r in rows.collect()}
    assert [found[0][i] for i in order] == [own[i] for i in order[-1:] + order[:-1]]


def test_forests_are_fitted_and_judged_on_every_row(spark):
    rows = forest.labelled_rows(answered(spark, 200_500, [G, X], "hd", "id"), [G, X], "hd", "Yes", "id")
    grown = forest.fit_forest(rows, [G, X], trees=3, max_depth=2)
    drawn = rows.select("y", F.transform(forest.draws(3, 200), forest.times_drawn).alias("w"))
    sums = drawn.groupBy("y").agg(*[F.sum(F.col("w")[t]) for t in range(3)]).orderBy("y").collect()
    assert [t.counts[0].tolist() for t in grown.trees] == [[sums[0][t + 1], sums[1][t + 1]] for t in range(3)]
    left_out = drawn.agg(*[F.count_if(F.exists(F.slice("w", 1, t + 1), lambda n: n == 0)) for t in range(3)]).first()
    errors = forest.curve_errors(forest.oob_curve(rows, grown)).orderBy("trees").collect()
    assert [r.n_rows for r in errors] == list(left_out)
    asked = forest._drops(rows, grown, 200, 1000).where("term = 0").groupBy("tree").agg(F.sum("asked").alias("n")).orderBy("tree").collect()
    assert [r.n for r in asked] == list(drawn.agg(*[F.count_if(F.col("w")[t] == 0) for t in range(3)]).first())


def test_permutation_importance_finds_the_real_predictor(people):
    noisy = people.withColumn("z", F.pmod(F.xxhash64("id"), F.lit(5)).cast("double"))
    terms = [G, X, Term("z")]
    rows = forest.labelled_rows(noisy, terms, "hd", "Yes", "id")
    model = forest.fit_forest(rows, terms, trees=15, max_depth=6)
    drop = {r.term: r.importance for r in forest.permutation_importance(rows, model).collect()}
    assert drop["g"] > 0.02 and drop["x"] > 0.02 and drop["z"] < min(drop["g"], drop["x"])
    predicted = forest.predict_forest(rows, model)
    assert predicted.where("predicted = actual").count() > 0.55 * 1500


def test_class_of_missing_and_undeclared_answers_is_missing(people):
    patterns = answer_patterns(people, [G, X], "hd", "Yes")
    pruned = pruning.prune(trees.grow_tree(patterns, [G, X], max_depth=4), 0.0)
    kind = dict(people.dtypes)["g"]
    odd = people.limit(3).withColumn("g", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("zz")).cast(kind))
    rows = pruning.predict_class(people.limit(50).unionByName(odd), pruned).collect()
    assert len(rows) == 53 and sum(r.predicted is None for r in rows) >= 3


def test_the_plan_of_a_prediction_does_not_grow_with_the_tree(people):
    patterns = answer_patterns(people, [G, H, X], "hd", "Yes")
    tree = trees.grow_tree(patterns, [G, H, X], min_split=2, min_bucket=1)
    sizes, cps = [], (0.5, 0.0)
    for cp in cps:
        pruned = pruning.prune(tree, cp)
        predicted = pruning.predict_class(people, pruned)
        plan = predicted._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(len(plan))
        assert predicted.where("hd <> predicted").count() == pruned.loss
    assert len(pruned.nodes()) > 40 and sizes[1] < 1.1 * sizes[0]


def test_separated_coefficient_has_an_infinite_limit(spark):
    def solve(f, *ends):
        search = likelihood.root(*ends)
        value = next(search)
        while True:
            try:
                value = search.send(f(value))
            except StopIteration as end:
                return end.value

    assert solve(lambda v: -1.0 / (1 + abs(v)), 0.0, 1.0, -2.0) == math.inf
    assert solve(lambda v: -1.0 / (1 + abs(v)), 0.0, -1.0, -2.0) == -math.inf
    assert abs(solve(lambda v: v * v - 2, 0.0, 1.0, -2.0) - math.sqrt(2)) < 1e-4
    rows = [("u", "No")] * 40 + [("u", "Yes")] * 20 + [("v", "Yes")] * 30
    patterns = answer_patterns(spark.createDataFrame(rows, "h string, hd string"), [H], "hd", "Yes")
    fit = logit.fit_logit(patterns, [H])
    assert fit.estimates["hv"] > 10
    limits = {r.coefficient: r for r in logit.odds_ratio_limits(spark, fit, patterns, method="profile").collect()}
    assert limits["(Intercept)"].upper < 1 and (limits["hv"].upper is None or limits["hv"].upper > 1e6)


def test_heights_are_those_of_the_rows(people):
    patterns = answer_patterns(people, [G, X], "hd", "Yes")
    y, x = numpy_design(people, [G, X])
    points = [likelihood.Point(np.arange(4), np.array([-1, 0.5, -0.2, 0.1])), likelihood.Point(np.array([0, 3]), np.array([0.3, -40.0]))]
    design = likelihood.spread(patterns, list(logit.design_columns([G, X]).values()))
    for point, got in zip(points, likelihood.heights(design, points)):
        mine = x[:, point.columns]
        linear = mine @ point.beta
        p = 1 / (1 + np.exp(-linear))
        assert np.allclose(got.gradient, mine.T @ (y - p)) and np.allclose(got.information, (mine * (p * (1 - p))[:, None]).T @ mine)
        assert math.isclose(got.deviance, 2 * np.sum(np.logaddexp(0, np.where(y == 1, -linear, linear))), rel_tol=1e-10)


def test_models_come_back_from_their_tables(spark, people, tmp_path):
    terms = [G, H, X]
    rows = forest.labelled_rows(people, terms, "hd", "Yes", "id")
    grown = forest.fit_forest(rows, terms, trees=3, max_depth=5)
    store.node_rows(spark, grown.trees, terms).write.parquet(str(tmp_path / "nodes"))
    other = spark.newSession()
    nodes = other.read.parquet(str(tmp_path / "nodes"))
    assert all(same_tree(a, b) for a, b in zip(grown.trees, store.read_trees(nodes, terms), strict=True))
    again = other.createDataFrame(rows.withColumnRenamed("row_id", "id").toPandas())
    said = {(r.id, r.tree): r["class"] for r in store.score_by_nodes(again, nodes, terms, "id").collect()}
    given = rows.select("row_id", *[t.position().alias(t.name) for t in terms]).collect()
    values = np.array([[r[t.name] for t in terms] for r in given])
    assert said == {(r.row_id, k): ("No", "Yes")[c] for k, tree in enumerate(grown.trees) for r, c in zip(given, tree.classes(values))}

    fit = logit.fit_logit(answer_patterns(people, terms, "hd", "Yes"), terms)
    store.coefficient_rows(spark, fit).write.parquet(str(tmp_path / "logit"))
    read = store.probability_from(other.read.parquet(str(tmp_path / "logit")), terms)
    both = people.select(fit.probability().alias("a"), read.alias("b")).collect()
    assert all((r.a is None and r.b is None) or math.isclose(r.a, r.b, rel_tol=1e-12) for r in both)
