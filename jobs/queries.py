"""The jobs as queries over the whole tables, and their SQL."""

from __future__ import annotations

from .conversation_series import JOB2_SQL, job2_conversation_series
from .forecast_frames import JOB1_SQL, job1_forecast_frames

QUERIES = {f.__name__: f for f in (job1_forecast_frames, job2_conversation_series)}
ORACLES = {"job1_forecast_frames": JOB1_SQL, "job2_conversation_series": JOB2_SQL}
