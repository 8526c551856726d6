"""rota - roster analytics on Spark.

Dated assignments, validity intervals, dimension lookups and access rules
re-expressed as lazy DataFrame operators. Every operator takes DataFrames and
returns a DataFrame. Operators trigger no action; ``employee_report`` computes its
shared inputs with checkpoints while it is built.
"""

from rota.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
