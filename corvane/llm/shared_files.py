"""Byte files in the shared folder, opened inside tasks through pyarrow's file systems.

``file://``, ``hdfs://``, ``s3://`` and the like all go through ``FileSystem.from_uri``; a
plain local path is never assumed.
"""

from __future__ import annotations

import re

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; Hadoop's ``file:/x`` is taken as ``file:///x``."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
