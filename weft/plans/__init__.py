"""Plan building blocks: materialisation in shared storage and the fixpoint loop."""
