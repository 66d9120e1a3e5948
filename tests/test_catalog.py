"""Every registered query against its SQL on the smallest tables, and the contract itself."""

import os
import subprocess
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract
import check_queries
from sievegrid.plans import registry

registry.load_all()
# Eigenvalues, singular values, alignment scores and what is built on them: no SQL, see the other tests.
WITHOUT_SQL = {
    "a23_vendi",
    "c1_sequence_clusters",
    "c6_template_match",
    "f15_search_identity",
    "f16_score_to_reference",
    "g1_aligned_rmsd",
    "g8_planarity",
    "j20_clashing_chains",
    "t5_diverse_selection",
}

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    return check_queries.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    function, sql = contract.queries()[name], contract.oracle_sql().get(name)
    state, rows, _, _, note = check_queries.compare(spark, duck, SF, name, function, sql)
    assert state == ("rows-only" if name in WITHOUT_SQL else "ok"), note


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_returns_ranks(spark):
    df = contract.entry(spark)
    assert df.columns == ["epoch", "uid", "block", "final_score", "rank"]
    assert df.count() > 0


def test_contract_without_the_corpus_operators():
    """Importing works, and only their queries are missing, where their package isn't installed."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[:2] == ['sievegrid', 'llm'] or name == 'corpus_pipeline':
            raise ModuleNotFoundError(f'No module named {name!r}', name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as contract
from sievegrid.plans import registry
names = set(contract.queries())
assert names == set(registry.QUERIES) and set(contract.oracle_sql()) == set(registry.ORACLES)
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
