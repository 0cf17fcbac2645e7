from quillmark.cli import main

raise SystemExit(main())
