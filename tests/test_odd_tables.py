"""Queries against their SQL on tables whose last group is not whole."""

import pytest

from eigenloom import queries
from eigenloom.operators import deltas as D
from eigenloom.roles import Roles

from .checks import duck, rows_of

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def cut(tmp_path_factory):
    """A function from a number of rows to a folder of the smallest tables with so many rows of ``embeddings``."""
    made = {}

    def folder(rows: int) -> str:
        if rows not in made:
            at = tmp_path_factory.mktemp(f"rows{rows}")
            for t in TABLES:
                (at / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
            duck(SF).execute(f"COPY (SELECT * FROM embeddings WHERE vec_id < {rows} ORDER BY vec_id) TO '{at}/embeddings.parquet'")
            made[rows] = str(at)
        return made[rows]

    return folder


def same_as_sql(spark, folder, name):
    got, want = queries.queries()[name](spark, folder), duck(folder).execute(queries.oracle_sql()[name])
    assert rows_of(got.columns, got.collect()) == rows_of([c[0] for c in want.description], want.fetchall())


def test_dispersion_of_an_item_with_one_matrix(spark, cut):
    same_as_sql(spark, cut(476), "dispersion_qc")


@pytest.mark.parametrize("name", ["pair_to_mean_deltas", "duplicate_domain_deltas", "source_sizes", "group_to_mean_deltas", "full_rank_pca_energy"])
def test_deltas_of_a_group_with_one_domain(spark, cut, name):
    same_as_sql(spark, cut(476), name)


def test_matrices_that_no_row_asks_for_are_not_absent(spark, cut):
    same_as_sql(spark, cut(478), "absent_matrices")


def test_mixtures_of_a_group_that_lacks_domains(spark, cut):
    same_as_sql(spark, cut(478), "synthetic_domains")


@pytest.mark.parametrize("rows", [476, 478, 500])
def test_every_group_has_a_delta_of_each_domain(spark, cut, rows):
    same_as_sql(spark, cut(rows), "low_rank_hard_map")


def test_deltas_of_domains_that_a_group_lacks_are_zero_and_change_no_other(spark):
    rows = spark.createDataFrame([(1, "A", [1.0, 2.0]), (1, "B", [4.0, 0.0]), (2, "C", [5.0, 5.0]), (3, "A", [0.0, 1.0]), (3, "B", [1.0, 3.0]), (3, "C", [2.0, 2.0])], "g long, d string, x array<double>")
    roles = Roles(domain="d", group="g", vector="x")
    of = lambda **options: {(r.g, r.domain_a): r.delta for r in D.domain_deltas(rows, roles, least=1, **options).collect()}
    plain, filled = of(), of(domains=["A", "B", "C"])
    assert len(plain) == 6 and filled == plain | {(1, "C"): [0.0, 0.0], (2, "A"): [0.0, 0.0], (2, "B"): [0.0, 0.0]}
    with pytest.raises(ValueError, match="to a mean only"):
        of(mode="group_pairwise", domains=["A"])


@pytest.mark.parametrize("name", ["fold_assignment", "concept_chains", "concept_moments", "concept_stages", "paired_grid", "sgd_separable"])
def test_folds_where_the_last_group_is_short(spark, cut, name):
    same_as_sql(spark, cut(478), name)


def test_means_that_end_in_a_five_at_the_seventh_place(spark):
    """0.137 (k + 1) (1 + vec_id % 3) over the rows of fold 3 and k of 0 to 3 has the mean 0.6867125."""
    got = queries.queries()["concept_deltas"](spark, "/root/testdata/sf0.1").filter("fold = 3 AND source = 'stain.target'").collect()
    assert len(got) == 6 and {r.mean_raw_norm for r in got} == {0.686713}
