"""Personal-activity analytics as PySpark DataFrame operators."""

from chronicle.params import Params
from chronicle.session import build_session, prepare

__all__ = ["Params", "build_session", "prepare"]
