"""No local checkpoint folder on a cluster."""

from types import SimpleNamespace

import pytest

from ephysframe.session import checkpoint_dir


@pytest.mark.parametrize("master", ["yarn", "local-cluster[3,2,3000]", "spark://host:7077"])
def test_checkpoint_dir_refuses_local_folder_on_cluster(master):
    fake = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: None, set=lambda k, v: None),
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None),
    )
    with pytest.raises(RuntimeError, match="shared folder"):
        checkpoint_dir(fake)
