import os
from pathlib import Path

# Python workers find the package here; set before any session starts.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [str(Path(__file__).resolve().parents[2]), *filter(None, [os.environ.get("PYTHONPATH")])])
