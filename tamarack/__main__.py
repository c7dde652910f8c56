import sys

from .cli import main

sys.exit(main(sys.argv[2:] if sys.argv[1:2] == ["detect"] else None))
