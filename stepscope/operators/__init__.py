"""Analytics operators. Every public function takes and returns DataFrames."""
