"""What the tests of these operators share."""

from __future__ import annotations

import os

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
