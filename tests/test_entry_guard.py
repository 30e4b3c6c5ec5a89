"""The entry without the training-data subpackage, and the shared folder on a cluster."""

import sys

import pytest

import __spark_entry__ as entry
from graphweft import session


def test_a_missing_dependency_of_the_subpackage_leaves_the_other_queries(monkeypatch):
    whole = set(entry.queries())
    monkeypatch.setitem(sys.modules, "graphweft.llm.queries", None)  # importing it raises ImportError
    rest = set(entry.queries())
    assert rest and rest <= whole and not rest & {"p1_found", "p3_found", "p5_found", "p6_ids", "p7_found", "p8_found"}
    assert set(entry.oracle_sql()) <= rest


class _Context:
    """A context of a cluster without a shared folder."""

    master = "spark://host:7077"

    class _jsc:
        class sc:
            def getCheckpointDir(self):
                return self

            def isDefined(self):
                return False

    def getConf(self):
        return {}


class _Session:
    sparkContext = _Context()

    class conf:
        @staticmethod
        def get(name, default=None):
            return default


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError):
        session.shared_dir(_Session())
