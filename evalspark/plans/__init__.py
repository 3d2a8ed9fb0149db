"""Driver-table plans. Importing this package registers every plan in the catalog."""

from evalspark.plans import catalog  # noqa: F401
from evalspark.plans import scoring_plans  # noqa: F401
from evalspark.plans import collect_plans  # noqa: F401
from evalspark.plans import analysis_plans  # noqa: F401
from evalspark.plans import text_plans  # noqa: F401
from evalspark.plans import registry_plans  # noqa: F401
from evalspark.plans import more_plans  # noqa: F401
from evalspark.plans import collect_shapes  # noqa: F401
from evalspark.plans import source_plans  # noqa: F401

QUERIES = catalog.QUERIES
ORACLE = catalog.ORACLE
