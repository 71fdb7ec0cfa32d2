"""Where rows come from and where state goes."""
