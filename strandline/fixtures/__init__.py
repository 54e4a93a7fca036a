from strandline.fixtures.ansi import with_tables
from strandline.fixtures.tables import Fixtures

__all__ = ["Fixtures", "with_tables"]
