"""Pure Column functions: no shuffle, no Python workers, safe inside whole-stage codegen."""
