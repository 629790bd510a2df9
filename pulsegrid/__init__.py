"""pulsegrid: telemetry and incident analytics expressed as Spark DataFrame plans.

Logs, metrics and spans go in; breaches, sessions, signatures, recurrence
decisions, case state and read models come out. Every public function takes
and returns DataFrames so the same code serves batch replays and streams.
"""

__version__ = "0.1.0"
