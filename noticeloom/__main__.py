import sys

from noticeloom.cli import main

sys.exit(main())
