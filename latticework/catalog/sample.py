"""A small project to query: sources as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = {
    "src/app/__init__.py": "from app.core.model import Model\n",
    "src/app/core/__init__.py": "",
    "src/app/core/model.py": '''"""Models."""
import functools
import os
from app.core import store

LIMIT = 3
cache = {}


class Model:
    """A model."""

    def save(self, target: str) -> int:
        """Save.

        :param target: where
        :param mode: how
        """
        cache.update({target: 1})
        return store.write(target)

    def _inner(self):
        return [x for x in range(LIMIT)]


@functools.lru_cache
def size(path: str) -> int:
    return len(path) if os.path.exists(path) else 0


def helper(items, box):
    items.append(1)
    box.count = 2
    box["k"] = 3
    rows = [1, 2]
    return rows


def _private():
    return missing_name
''',
    "src/app/core/store.py": '''from app.core import model


def write(target: str) -> int:
    """Write."""
    print(target)
    return 1


def reset():
    global state
    state = 1


def Lonely() -> int:
    return 2
''',
    "src/app/web/__init__.py": "",
    "src/app/web/view.py": '''from app import Model
from app.core.model import _private, helper as h
from app.core.store import *
import json

Model().save("x")
h([], {})
_private()
''',
    "src/app/web/plain.py": "def used_here():\n    return 1\n\n\nused_here()\n",
    "src/app/broken.py": "def (:\n",
    "tests/test_store.py": "from app.core.store import reset\n\n\ndef test_reset():\n    reset()\n",
}


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, c.encode()) for p, c in FILES.items()], "path string, content binary")
