"""marketmap: build and maintain a company sector map with Spark.

Every public function takes and returns DataFrames (or Columns); nothing
collects more than a one-row decision to the driver.
"""

from marketmap.session import get_session, state_root

__all__ = ["get_session", "state_root"]
