"""Plan guards: no Python UDF nodes in any query of the comment and post engine; text scans read only the columns they need."""

import importlib.util
import os

import __spark_entry__ as E
from corpusforge.plans.queries import REGISTRY

_spec = importlib.util.spec_from_file_location(
    "explain_plans", os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools", "explain_plans.py"))
EP = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(EP)


def test_no_python_udfs_and_pruned_scans(spark, sf_dir):
    for key, fn in REGISTRY.items():
        if key.startswith("stream_"):
            continue
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        s = EP.summarize(plan)
        assert s["python_udfs"] == 0, key
        for schema in s["scans"]:
            # the only wide table is documents; no query reads every one of its columns unless it needs them
            assert "n_chars" not in schema or key in ("cohens_kappa", "agreement_matrix"), (key, schema)


def test_text_rules_are_pruned_to_text(spark, sf_dir):
    plan = E.queries()["drop_reason_counts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
