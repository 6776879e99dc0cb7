"""Physical shapes shared by the operators: order statistics, bounded windows, time and space joins."""
