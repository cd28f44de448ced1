"""Package part: named queries over the fixture tables, with SQL that gives the same rows."""

from . import alignments, documents, extras, learner, materials, pages, reports, scalars, search, streams, timeline  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
