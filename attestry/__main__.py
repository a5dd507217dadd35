import sys

from attestry.cli import main

sys.exit(main())
