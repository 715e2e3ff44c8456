"""The driver contract, with and without the optional text operators."""

import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parents[1]


def run(code):
    return subprocess.run([sys.executable, "-c", code], cwd=HERE, capture_output=True, text=True, timeout=120)


def test_works_without_the_text_operators():
    code = "import sys; sys.modules['spanwise.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'detect_spells' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    done = run(code)
    assert done.returncode == 0, done.stderr


def test_works_without_a_package_of_theirs():
    code = "import sys, warnings; sys.modules['regex'] = None; warnings.simplefilter('error', UserWarning)\ntry:\n    import __spark_entry__\nexcept UserWarning as w:\n    assert 'regex' in str(w)\nelse:\n    assert 'regex' not in sys.modules or sys.modules['regex'] is None\nwarnings.simplefilter('ignore'); import __spark_entry__ as e; assert 'detect_spells' in e.queries()"
    done = run(code)
    assert done.returncode == 0, done.stderr


def test_entry(spark):
    sys.path.insert(0, str(HERE))
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns == ["member_id", "spell_id", "entry_date", "raw_exit_date", "extended_exit_date", "spell_length_days"] and found.count() > 300
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
