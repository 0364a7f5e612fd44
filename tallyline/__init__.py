"""tallyline: subscription billing analytics on Spark."""

from tallyline.functions.thresholds import Thresholds
from tallyline.operators.ledger import Ledger
from tallyline.plans.analyze import Analysis, ChurnInputs, analyze
from tallyline.session import configure, local_session

__all__ = ["Analysis", "ChurnInputs", "Ledger", "Thresholds", "analyze", "configure", "local_session"]
