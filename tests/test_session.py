"""The scratch folder."""

import os
from types import SimpleNamespace

import pytest

from marginalia.queries.inputs import forget_saved
from marginalia.session import clear_scratch, scratch_folder, shared_folder
from marginalia.sources.corpora import materialize


def test_scratch_tables_of_an_application_lie_together_and_can_be_cleared(spark):
    table = materialize(spark.range(5))
    one, two = scratch_folder(spark), scratch_folder(spark)
    home = os.path.dirname(one)
    assert one != two and home == os.path.dirname(two) and os.path.isdir(home) and table.count() == 5
    clear_scratch(spark)
    forget_saved()
    assert not os.path.exists(home)
    assert materialize(spark.range(3)).count() == 3 and os.path.dirname(scratch_folder(spark)) != home


@pytest.mark.parametrize("master,fine", [("local", True), ("local[8]", True), ("local-cluster[3,2,1024]", False), ("yarn", False), ("spark://host:7077", False)])
def test_a_cluster_needs_a_shared_folder(master, fine):
    settings = {"spark.sql.warehouse.dir": "/warehouse"}
    bare = SimpleNamespace(conf=settings, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    if fine:
        assert shared_folder(bare) == "/warehouse/scratch"
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(bare)
    settings["spark.checkpoint.dir"] = "/shared"
    assert shared_folder(bare) == "/shared"
