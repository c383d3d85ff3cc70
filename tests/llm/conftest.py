import os
import sys

import pytest

pytest.importorskip("phenospark.llm")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
