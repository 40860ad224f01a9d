"""Where rows come from and where points go."""
