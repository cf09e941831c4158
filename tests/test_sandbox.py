import json
import subprocess

import pytest

from quarrylight.operators import sandbox

CHILD = """
job = json.load(sys.stdin)
if job["sleep"]:
    time.sleep(5)
seen = vars(json).setdefault("seen", [])
seen.append(1)
print("noise")
sys.__stdout__.write("\\n" + json.dumps([os.getpid(), os.getppid(), len(seen), os.listdir(".")]))
"""


def test_jobs_are_forked_from_one_process_and_share_nothing():
    job = {"sleep": False}
    (a, above, *first), (b, same, *second) = (json.loads(sandbox.run_job(CHILD, job, 5).rsplit("\n", 1)[-1]) for _ in range(2))
    assert a != b and above == same
    assert first == second == [1, []]


def test_a_late_job_is_ended_and_the_next_one_runs():
    with pytest.raises(subprocess.TimeoutExpired):
        sandbox.run_job(CHILD, {"sleep": True}, 0.2)
    assert sandbox.run_job(CHILD, {"sleep": False}, 5)
