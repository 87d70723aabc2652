from __future__ import annotations

import pytest

from archivolt.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", cores=4, checkpoint=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()
