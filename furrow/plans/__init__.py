from furrow.plans import calendar_and_features, joins, learning, models, panels, records, runs, tuning  # noqa: F401
from furrow.plans.register import QUERIES, SQL  # noqa: F401
